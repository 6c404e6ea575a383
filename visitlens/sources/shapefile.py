"""Shapefiles as a Spark data source: `spark.dataSource.register(ShapefileSource)`, then format("shapefile").

Reading plans partitions of `records` records of each file under the path: the index file says where they are, so a task reads
one byte range of the shapes and one of the attribute table. Columns: the attributes with the types of the first table,
`source` (the file's name), `record` (its number, from 0) and `rings`: (part, hole, xs, ys) of every ring, without the point
that closes it. Outer rings turn clockwise and holes the other way; a hole is of the part that it lies in. Lines and points
come as open parts. Empty shapes have no rings; records marked as deleted are left out; blank attributes are null.

Writing (append) takes strings, whole numbers, doubles, booleans and a column `rings` of (hole, xs, ys); every task writes sets
of files of its own, put in place when all tasks are done; it holds the rows of one set at a time.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from visitlens.sources.files import Parts, files_under, opened

#: Codes and sizes of the format (fixed values).
FILE_CODE, VERSION, HEADER, NOTHING, POINTS, LINES, POLYGONS = 9994, 1000, 100, 0, (1, 11, 21), (3, 13, 23), (5, 15, 25)
#: A writer's set of files has no more rows or bytes of shapes than these, and takes up so many rows at a time.
FILE_ROWS, FILE_BYTES, STEP_ROWS = 20_000, 64 << 20, 1_000
RING = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("hole", T.BooleanType()), T.StructField("xs", T.ArrayType(T.DoubleType())), T.StructField("ys", T.ArrayType(T.DoubleType()))])


@dataclass
class Field:
    name: str
    kind: str
    size: int
    decimals: int

    def type(self) -> T.DataType:
        if self.kind == "N" and not self.decimals and self.size <= 18:
            return T.LongType()
        return {"N": T.DoubleType(), "F": T.DoubleType(), "L": T.BooleanType()}.get(self.kind, T.StringType())

    def value(self, raw: bytes, encoding: str):
        text = raw.decode(encoding, "replace").strip(" \0")
        if not text or (self.kind in "NF" and text.startswith("*")):
            return None
        if self.kind == "L":
            return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
        if self.kind in "NF":
            return int(text) if isinstance(self.type(), T.LongType) else float(text)
        return text


@dataclass
class Table:
    """The header of an attribute table."""

    rows: int
    start: int
    width: int
    fields: list[Field]
    encoding: str


def beside(path: str, ending: str, store) -> str | None:
    """The file of the same name with another ending, whichever case it has."""
    stem = path.rpartition(".")[0]
    names = [f"{stem}.{e}" for e in (ending, ending.upper())]
    return next((i.path for i in store.get_file_info(names) if i.is_file), None)


def read_table(path: str, store) -> Table | None:
    at = beside(path, "dbf", store)
    if at is None:
        return None
    file = Parts(store, at)
    rows, start, width = struct.unpack("<4xIHH", file.at(0, 12))
    head = file.at(0, start)
    fields = []
    for i in range(32, start - 1, 32):
        if head[i] == 0x0D:
            break
        name, kind, size, decimals = struct.unpack("<11sc4xBB", head[i : i + 18])
        fields.append(Field(name.split(b"\0")[0].decode("latin-1"), kind.decode(), size, decimals))
    page = beside(path, "cpg", store)
    encoding = "utf-8" if page is None else Parts(store, page).at(0, Parts(store, page).size()).decode().strip() or "utf-8"
    return Table(rows, start, width, fields, "latin-1" if encoding.lower() in ("iso-8859-1", "8859-1", "88591") else encoding)


def turn(xs: np.ndarray, ys: np.ndarray) -> float:
    """Twice the area of a ring, positive if it turns to the left."""
    x, y = xs - xs[0], ys - ys[0]
    return float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))


def holds(xs: np.ndarray, ys: np.ndarray, x: float, y: float) -> bool:
    x2, y2 = np.roll(xs, -1), np.roll(ys, -1)
    up = (ys > y) != (y2 > y)
    return bool(np.sum(up & (x < (x2 - xs) * (y - ys) / np.where(up, y2 - ys, 1) + xs)) % 2)


def rings_of(content: bytes) -> list[tuple[int, bool, list[float], list[float]]]:
    """(part, hole, xs, ys) of a record's shape."""
    kind = struct.unpack("<i", content[:4])[0]
    if kind == NOTHING:
        return []
    if kind in POINTS:
        x, y = struct.unpack("<dd", content[4:20])
        return [(0, False, [x], [y])]
    if kind not in LINES + POLYGONS:
        raise ValueError(f"shape type {kind}")
    parts, points = struct.unpack("<ii", content[36:44])
    begins = np.append(np.frombuffer(content, "<i4", parts, 44), points)
    xy = np.frombuffer(content, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2)
    own = [xy[a:b] for a, b in zip(begins[:-1], begins[1:], strict=True)]
    if kind in LINES:
        return [(i, False, p[:, 0].tolist(), p[:, 1].tolist()) for i, p in enumerate(own)]
    own = [p[:-1] if len(p) > 1 and (p[0] == p[-1]).all() else p for p in own]
    sides = [turn(p[:, 0], p[:, 1]) for p in own]
    outer = [i for i, s in enumerate(sides) if s <= 0]
    out = []
    for i, p in enumerate(own):
        around = [o for o in outer if holds(own[o][:, 0], own[o][:, 1], *p[0])] if sides[i] > 0 else [i]
        part = min(around, key=lambda o: abs(sides[o])) if around else max((o for o in outer if o < i), default=i)
        out.append((outer.index(part) if part in outer else 0, sides[i] > 0 and bool(outer), p[:, 0].tolist(), p[:, 1].tolist()))
    return out


@dataclass
class Records(InputPartition):
    path: str
    first: int
    count: int


@dataclass
class ShapefileReader(DataSourceReader):
    path: str
    records: int
    schema: T.StructType

    def partitions(self) -> list[Records]:
        store, _ = opened(self.path)
        out = []
        for path in files_under(self.path, ".shp"):
            index = beside(path, "shx", store)
            if index is None:
                raise FileNotFoundError(f"no index file for {path}")
            n = (Parts(store, index).size() - HEADER) // 8
            out += [Records(path, i, min(self.records, n - i)) for i in range(0, n, self.records)]
        return out

    def read(self, partition: Records | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing was planned
            return
        store, _ = opened(self.path)
        index = np.frombuffer(Parts(store, beside(partition.path, "shx", store)).at(HEADER + 8 * partition.first, 8 * partition.count), ">i4").reshape(-1, 2).astype(np.int64) * 2
        low, high = int(index[:, 0].min()), int((index[:, 0] + 8 + index[:, 1]).max())
        shapes = Parts(store, partition.path).at(low, high - low)
        table = read_table(partition.path, store)
        rows = Parts(store, beside(partition.path, "dbf", store)).at(table.start + table.width * partition.first, table.width * partition.count) if table else b""
        names = self.schema.fieldNames()
        columns: dict[str, list] = {n: [] for n in names}
        for i, (offset, size) in enumerate(index.tolist()):
            row = rows[i * table.width : (i + 1) * table.width] if table else b" "
            if row[:1] == b"*":
                continue
            own, at = {"source": partition.path.rpartition("/")[2], "record": partition.first + i}, 1
            for f in table.fields if table else ():
                own[f.name] = f.value(row[at : at + f.size], table.encoding)
                at += f.size
            own["rings"] = [dict(zip(("part", "hole", "xs", "ys"), r, strict=True)) for r in rings_of(shapes[offset - low + 8 : offset - low + 8 + size])]
            for n in names:
                value = own.get(n)
                columns[n].append(str(value) if value is not None and isinstance(self.schema[n].dataType, T.StringType) else value)
        from pyspark.sql.pandas.types import to_arrow_schema

        yield pa.record_batch([pa.array(columns[f.name], f.type) for f in to_arrow_schema(self.schema)], names=names)


def shape_of(rings: list[dict]) -> bytes:
    """A polygon's record content; outer rings are turned clockwise and holes the other way."""
    own = []
    for r in rings or []:
        xs, ys = np.array(r["xs"], float), np.array(r["ys"], float)
        by = slice(None) if (turn(xs, ys) > 0) == bool(r["hole"]) else slice(None, None, -1)
        own.append(np.stack([xs[by], ys[by]], 1))
    if not own:
        return struct.pack("<i", NOTHING)
    own = [np.concatenate([p, p[:1]]) for p in own]
    sizes, xy = [len(p) for p in own], np.concatenate(own)
    begins = np.cumsum([0, *sizes[:-1]]).astype("<i4").tobytes()
    return struct.pack("<i4dii", 5, *xy.min(0), *xy.max(0), len(own), len(xy)) + begins + xy.astype("<f8").tobytes()


def header(words: int, box: tuple[float, ...]) -> bytes:
    return struct.pack(">i20xi", FILE_CODE, words) + struct.pack("<ii8d", VERSION, 5, *box, 0, 0, 0, 0)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


@dataclass
class ShapefileWriter(DataSourceArrowWriter):
    path: str
    schema: T.StructType

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Rows are held until the sizes of a set of files are known: FILE_ROWS of them, or FILE_BYTES of shapes, and no more."""
        names = [f.name for f in self.schema if f.name != "rings"]
        own, shapes, held, files = {n: [] for n in names}, [], 0, []
        for batch in iterator:
            for a in range(0, len(batch), STEP_ROWS):
                part = batch.slice(a, STEP_ROWS)
                for n in names:
                    own[n] += part.column(n).to_pylist()
                new = [shape_of(r) for r in part.column("rings").to_pylist()]
                shapes, held = shapes + new, held + sum(map(len, new))
                if len(shapes) >= FILE_ROWS or held >= FILE_BYTES:
                    files += self.put(own, shapes)
                    own, shapes, held = {n: [] for n in names}, [], 0
        return Written(files + self.put(own, shapes) if shapes else files)

    def put(self, own: dict[str, list], shapes: list[bytes]) -> list[tuple[str, str]]:
        """Writes a set of files of the columns and shapes; their paths, for now and in the end."""
        names = list(own)
        ends = np.cumsum([HEADER, *(8 + len(s) for s in shapes)])
        boxes = np.array([struct.unpack("<4d", s[4:36]) for s in shapes if len(s) > 4] or [(0.0,) * 4])
        box = (*boxes[:, :2].min(0), *boxes[:, 2:].max(0))
        shp = header(int(ends[-1]) // 2, box) + b"".join(struct.pack(">ii", i + 1, len(s) // 2) + s for i, s in enumerate(shapes))
        shx = header((HEADER + 8 * len(shapes)) // 2, box) + b"".join(struct.pack(">ii", int(a) // 2, len(s) // 2) for a, s in zip(ends, shapes, strict=False))
        cells, fields = [], []
        for n in names:
            kind = self.schema[n].dataType
            if isinstance(kind, T.BooleanType):
                letter, text = "L", [" " if v is None else "T" if v else "F" for v in own[n]]
            elif isinstance(kind, (T.DoubleType, T.FloatType)):
                letter, text = "F", ["" if v is None else repr(float(v)) for v in own[n]]
            elif isinstance(kind, T.IntegralType):
                letter, text = "N", ["" if v is None else str(v) for v in own[n]]
            else:
                letter, text = "C", ["" if v is None else str(v) for v in own[n]]
            raw = [t.encode() for t in text]
            size = {"L": 1, "N": 18, "F": 24}.get(letter) or max(1, *map(len, raw))
            if max(map(len, raw)) > min(size, 254) or len(n.encode()) > 10:
                raise ValueError(f"column {n} does not fit an attribute table")
            fields.append(struct.pack("<11sc4xBB14x", n.encode(), letter.encode(), size, 15 if letter == "F" else 0))
            cells.append([v.ljust(size) if letter in "CL" else v.rjust(size) for v in raw])
        width = 1 + sum(len(c[0]) for c in cells)
        start = 32 + 32 * len(fields) + 1
        dbf = struct.pack("<B3BIHH20x", 3, 100, 1, 1, len(shapes), start, width) + b"".join(fields) + b"\r" + b"".join(b" " + b"".join(c) for c in zip(*cells, strict=True)) + b"\x1a"
        store, at = opened(self.path)
        store.create_dir(f"{at}/_parts")
        mark, files = uuid.uuid4().hex, []
        for ending, data in (("shp", shp), ("shx", shx), ("dbf", dbf), ("cpg", b"UTF-8")):
            with store.open_output_stream(f"{at}/_parts/{mark}.{ending}") as out:
                out.write(data)
            files.append((f"{at}/_parts/{mark}.{ending}", f"{at}/{mark}.{ending}"))
        return files

    def commit(self, messages: list[Written | None]) -> None:
        store, at = opened(self.path)
        for part, to in (f for m in messages if m for f in m.files):
            store.move(part, to)
        store.create_dir(f"{at}/_parts")
        store.delete_dir(f"{at}/_parts")

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = opened(self.path)
        for part, _ in (f for m in messages if m for f in m.files):
            store.delete_file(part)


class ShapefileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> T.StructType:
        store, _ = opened(self.options["path"])
        found = files_under(self.options["path"], ".shp")
        table = read_table(found[0], store) if found else None
        own = [T.StructField(f.name, f.type()) for f in (table.fields if table else []) if f.name not in ("source", "record", "rings")]
        return T.StructType([*own, T.StructField("source", T.StringType()), T.StructField("record", T.LongType()), T.StructField("rings", T.ArrayType(RING))])

    def reader(self, schema: T.StructType) -> ShapefileReader:
        return ShapefileReader(self.options["path"], int(self.options.get("records", 10_000)), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> ShapefileWriter:
        if overwrite:
            raise ValueError("shapefiles are written by append, to a new folder")
        return ShapefileWriter(self.options["path"], schema)
