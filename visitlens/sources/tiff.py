"""GeoTIFF rasters as a Spark data source: `register(spark)`, then format("tiff").

Reading plans partitions of whole small files and of runs of strips or tiles of larger ones, up to `bytes` stored bytes (one
block at least; opening a file counts as OPEN_BYTES). A small file is not opened before its task unless filters may leave it out.
Directory, affine map, no-data value and block offsets come from the files' headers; a block is read by its byte
range and only in its own task. Equality and range filters on `row` and `col` leave out blocks. Rows: (row, col, x, y, value) of every pixel that is not no-data; row and col count
from the tie point, x and y are the pixel's centre. A mosaic of files that share an origin reads like one raster.

Writing (append) takes (row, col, value), gives every task's blocks of `block` x `block` pixels a file each, and puts these in
place when all tasks are done; deal rows out by block first. Missing pixels get the no-data value.

Read are both byte orders, classic and big files, strips and tiles, 8 to 64 bit whole numbers and floats, no compression,
deflate and LZW, with or without differences between neighbours. Written are deflated strips of doubles.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from visitlens.sources.files import Parts, files_under, opened

#: Tags of the format that are read or written (fixed values).
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_SIZES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, TRANSFORM, GEO_KEYS, NO_DATA = 33550, 33922, 34264, 34735, 42113
#: Codes of the format's field types, as struct letters (fixed values).
KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
#: What opening a file counts for beside its bytes.
OPEN_BYTES = 64 << 10
SCHEMA = "row bigint, col bigint, x double, y double, value double"


@dataclass
class Raster:
    """What the header of a file says."""

    width: int
    height: int
    block_width: int
    block_height: int
    offsets: list[int]
    sizes: list[int]
    dtype: np.dtype
    compression: int
    predictor: int
    row: int
    col: int
    x: float
    y: float
    dx: float
    dy: float
    no_data: float | None

    @property
    def across(self) -> int:
        return -(-self.width // self.block_width)

    def spans(self, i: int) -> tuple[int, int, int, int]:
        """First and last row, first and last column of block i, as they are counted in the rows read."""
        top, left = i // self.across * self.block_height, i % self.across * self.block_width
        return self.row + top, self.row + min(top + self.block_height, self.height) - 1, self.col + left, self.col + min(left + self.block_width, self.width) - 1


def read_header(file: Parts) -> Raster:
    start = file.at(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(start[:2])
    version = struct.unpack(f"{order}H", start[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError("no TIFF file")
    big = version == 43
    at = struct.unpack(f"{order}Q", start[8:16])[0] if big else struct.unpack(f"{order}I", start[4:8])[0]
    head, size = ("Q", 20) if big else ("H", 12)
    n = struct.unpack(f"{order}{head}", file.at(at, struct.calcsize(head)))[0]
    entries, tags = file.at(at + struct.calcsize(head), n * size), {}
    for i in range(n):
        entry = entries[i * size : (i + 1) * size]
        tag, kind, count = struct.unpack(f"{order}HH{'Q' if big else 'I'}", entry[: 12 if big else 8])
        if kind in KINDS:
            total = struct.calcsize(f"<{KINDS[kind]}") * count
            inline = entry[12 if big else 8 :]
            raw = inline[:total] if total <= len(inline) else file.at(struct.unpack(f"{order}{'Q' if big else 'I'}", inline)[0], total)
            tags[tag] = raw if kind == 2 else struct.unpack(f"{order}{count}{KINDS[kind]}", raw)
    one = lambda tag, default: tags.get(tag, (default,))[0]
    if one(SAMPLES, 1) != 1:
        raise ValueError("more than one sample for a pixel")
    dtype = np.dtype(f"{order}{'uif'[one(SAMPLE_FORMAT, 1) - 1]}{one(BITS, 1) // 8}")
    width, height = one(WIDTH, 0), one(HEIGHT, 0)
    if TRANSFORM in tags:
        t = tags[TRANSFORM]
        if t[1] or t[4]:
            raise ValueError("a turned raster")
        dx, dy, i, j, x, y = t[0], -t[5], 0, 0, t[3], t[7]
    else:
        dx, dy, _ = tags.get(PIXEL_SCALE, (1.0, 1.0, 0.0))
        i, j, _, x, y, _ = tags.get(TIE_POINT, (0, 0, 0, 0.0, 0.0, 0))[:6]
    tiled = TILES in tags
    none = tags[NO_DATA].rstrip(b"\0 ") if NO_DATA in tags else b""
    return Raster(
        width, height, one(TILE_WIDTH, width) if tiled else width, one(TILE_HEIGHT, height) if tiled else min(one(ROWS, height), height),
        list(tags[TILES if tiled else STRIPS]), list(tags[TILE_SIZES if tiled else STRIP_SIZES]), dtype, one(COMPRESSION, 1), one(PREDICTOR, 1),
        -int(j), -int(i), x, y, dx, dy, float(none) if none else None,
    )


def unpacked_lzw(data: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, most significant bit first, which grow one code early."""
    table: list[bytes] = [bytes([i]) for i in range(256)] + [b"", b""]
    out, before, bits, held, width = [], b"", 0, 0, 9
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            del table[258:]
            before, width = b"", 9
            continue
        entry = table[code] if code < len(table) else before + before[:1]
        out.append(entry)
        if before:
            table.append(before + entry[:1])
        before = entry
        width = min(12, (len(table) + 1).bit_length())
    return b"".join(out)


def read_block(file: Parts, r: Raster, i: int) -> np.ndarray:
    """The pixels of block i, as far as they are in the raster."""
    top, bottom, left, right = r.spans(i)
    shape = (r.block_height if r.block_width < r.width else bottom - top + 1, r.block_width)
    data = file.at(r.offsets[i], r.sizes[i]) if r.sizes[i] else b""
    if r.compression in (8, 32946):
        data = zlib.decompress(data)
    elif r.compression == 5:
        data = unpacked_lzw(data)
    elif r.compression != 1:
        raise ValueError(f"compression {r.compression}")
    if r.predictor == 3:  # bytes of a row by significance, as differences
        rows = np.cumsum(np.frombuffer(data, np.uint8).reshape(shape[0], -1), axis=1, dtype=np.uint8)
        planes = rows.reshape(shape[0], r.dtype.itemsize, shape[1]).transpose(0, 2, 1)
        pixels = np.ascontiguousarray(planes).view(r.dtype.newbyteorder(">"))[:, :, 0]
    else:
        pixels = np.frombuffer(data, r.dtype, count=shape[0] * shape[1]).reshape(shape)
        pixels = np.cumsum(pixels, axis=1, dtype=r.dtype) if r.predictor == 2 else pixels
    return pixels[: bottom - top + 1, : right - left + 1]


@dataclass
class Blocks(InputPartition):
    """Files with the blocks to be read, None: all."""

    files: list[tuple[str, list[int] | None]]


@dataclass
class Range:
    """Least and greatest whole number that filters leave."""

    low: float = -np.inf
    high: float = np.inf

    def add(self, f: Filter) -> None:
        if isinstance(f, (EqualTo, In)):
            values = f.value if isinstance(f, In) else [f.value]
            self.low, self.high = max(self.low, min(values, default=np.inf)), min(self.high, max(values, default=-np.inf))
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.low = max(self.low, f.value + isinstance(f, GreaterThan))
        else:
            self.high = min(self.high, f.value - isinstance(f, LessThan))


@dataclass
class TiffReader(DataSourceReader):
    path: str
    bytes: int
    rows: Range = field(default_factory=Range)
    cols: Range = field(default_factory=Range)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            of = {("row",): self.rows, ("col",): self.cols}.get(getattr(f, "attribute", None))
            if of is not None and isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                of.add(f)
            yield f  # blocks hold other rows too

    def partitions(self) -> list[Blocks]:
        store, _ = opened(self.path)
        paths = files_under(self.path, ".tif", ".tiff")
        every = all(np.isinf([x.low, x.high]).all() for x in (self.rows, self.cols))
        out, files, size = [], [], 0
        for info in store.get_file_info(paths):
            if every and info.size + OPEN_BYTES <= self.bytes:
                runs = [(None, info.size)]
            else:
                runs = self.runs(read_header(Parts(store, info.path)))
            for blocks, n in runs:
                if files and size + n + OPEN_BYTES > self.bytes:
                    out.append(Blocks(files))
                    files, size = [], 0
                files.append((info.path, blocks))
                size += n + OPEN_BYTES
        return [*out, Blocks(files)] if files else out

    def runs(self, r: Raster) -> list[tuple[list[int], int]]:
        """Runs of a file's blocks that filters leave, of up to `bytes` stored bytes, and their sizes."""
        out: list[tuple[list[int], int]] = []
        for i in range(len(r.offsets)):
            top, bottom, left, right = r.spans(i)
            if bottom < self.rows.low or top > self.rows.high or right < self.cols.low or left > self.cols.high:
                continue
            if out and out[-1][1] + r.sizes[i] <= self.bytes:
                out[-1][0].append(i)
                out[-1] = (out[-1][0], out[-1][1] + r.sizes[i])
            else:
                out.append(([i], r.sizes[i]))
        return out

    def read(self, partition: Blocks | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing was planned
            return
        store, _ = opened(self.path)
        for path, blocks in partition.files:
            file = Parts(store, path)
            r = read_header(file)
            for i in range(len(r.offsets)) if blocks is None else blocks:
                yield pa.record_batch([pa.array(c) for c in self.pixels(file, r, i)], names=["row", "col", "x", "y", "value"])

    def pixels(self, file: Parts, r: Raster, i: int) -> tuple[np.ndarray, ...]:
        """The columns of a block's pixels."""
        top, _, left, _ = r.spans(i)
        pixels = read_block(file, r, i)
        keep = np.ones(pixels.shape, bool) if r.no_data is None else ~np.isnan(pixels) if np.isnan(r.no_data) else pixels != r.no_data
        a, b = np.nonzero(keep)
        row, col = a + top, b + left
        return row, col, r.x + (col + 0.5) * r.dx, r.y - (row + 0.5) * r.dy, pixels[a, b].astype(float)


def file_of(pixels: np.ndarray, row: int, col: int, x: float, y: float, dx: float, dy: float, no_data: float, strip: int) -> bytes:
    """A file of doubles in deflated strips of `strip` rows, its first pixel at (row, col) of a raster with its corner at (x, y)."""
    strips = [zlib.compress(pixels[i : i + strip].astype("<f8").tobytes(), 6) for i in range(0, len(pixels), strip)]
    ends = np.cumsum([8, *map(len, strips)]).tolist()
    note = f"{no_data:g}".encode() + b"\0"
    tags: dict[int, tuple[int, list | bytes]] = {
        WIDTH: (4, [pixels.shape[1]]), HEIGHT: (4, [pixels.shape[0]]), BITS: (3, [64]), COMPRESSION: (3, [8]), PHOTOMETRIC: (3, [1]), STRIPS: (4, ends[:-1]),
        SAMPLES: (3, [1]), ROWS: (4, [strip]), STRIP_SIZES: (4, [len(s) for s in strips]), SAMPLE_FORMAT: (3, [3]),
        PIXEL_SCALE: (12, [dx, dy, 0.0]), TIE_POINT: (12, [-col, -row, 0, x, y, 0]), GEO_KEYS: (3, [1, 1, 0, 2, 1024, 0, 1, 2, 2048, 0, 1, 4326]), NO_DATA: (2, note),
    }
    entries, extra, at = b"", b"", ends[-1]
    at += at % 2
    beyond = at + 2 + 12 * len(tags) + 4
    for tag, (kind, values) in sorted(tags.items()):
        raw = values if kind == 2 else struct.pack(f"<{len(values)}{KINDS[kind]}", *values)
        entries += struct.pack("<HHI", tag, kind, len(values))
        entries += raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", beyond + len(extra))
        extra += raw + b"\0" * (len(raw) % 2) if len(raw) > 4 else b""
    body = b"".join(strips)
    return struct.pack("<2sHI", b"II", 42, at) + body + b"\0" * (at - ends[-1]) + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + extra


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


@dataclass
class TiffWriter(DataSourceArrowWriter):
    path: str
    options: dict[str, float]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        o = self.options
        size, mark, none = int(o["block"]), uuid.uuid4().hex, o["nodata"]
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in iterator:
            row, col = (batch.column(n).to_numpy().astype(np.int64) for n in ("row", "col"))
            value = batch.column("value").to_numpy(zero_copy_only=False).astype(float)
            block = np.stack([row // size, col // size], 1)
            for key in np.unique(block, axis=0):
                own = (block == key).all(1)
                pixels = held.setdefault(tuple(key.tolist()), np.full((size, size), none))
                pixels[row[own] % size, col[own] % size] = np.where(np.isnan(value[own]), none, value[own])
        store, at = opened(self.path)
        store.create_dir(f"{at}/_parts")
        files = []
        for (i, j), pixels in sorted(held.items()):
            part = f"{at}/_parts/{mark}-{i}-{j}"
            with store.open_output_stream(part) as out:
                out.write(file_of(pixels, i * size, j * size, o["x"], o["y"], o["dx"], o["dy"], none, int(o["strip"])))
            files.append((part, f"{at}/{i}-{j}.tif"))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """The parts get their names; a block that two tasks have written is an error."""
        moves = [f for m in messages if m for f in m.files]
        if len({to for _, to in moves}) < len(moves):
            raise ValueError("a block was dealt to more than one task")
        store, at = opened(self.path)
        for part, to in moves:
            store.move(part, to)
        store.delete_dir(f"{at}/_parts")

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = opened(self.path)
        for part, _ in (f for m in messages if m for f in m.files):
            store.delete_file(part)


class TiffSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TiffReader:
        return TiffReader(self.options["path"], int(self.options.get("bytes", 8 << 20)))

    def writer(self, schema, overwrite: bool) -> TiffWriter:
        if overwrite:
            raise ValueError("rasters are written by append, to a new folder")
        defaults = {"x": 0.0, "y": 0.0, "dx": 1.0, "dy": 1.0, "nodata": -1.0, "block": 512, "strip": 16}
        return TiffWriter(self.options["path"], {k: float(self.options.get(k, v)) for k, v in defaults.items()})


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TiffSource)
