"""Operator 9: media columns. Texts as ISO media files, and a box walker that reads such files' tables.

`to_media` stores bytes losslessly as 8-bit samples of 64 bytes in an ISO base media container: ftyp, moov
(one track with its sample tables) and mdat. `probe` walks the nested boxes of any such file and decodes the
sample tables of every track, those in movie fragments included: codec, time scale, duration, the samples' sizes and
offsets, and the byte ranges of the keyframes. It reads no payload; `payload` joins the samples' bytes where they are wanted.

`probe_media` has the ranges of every track in a column, and digests of the first track, the one with the lowest place.
A track whose tables are missing or break off is left out; a file without any gives nulls and no tracks.

Nulls: a null text is an empty one, a null id stays null. The payload of an empty text is one sample of zeros.
Equal texts give equal media, whatever their rows. Empty tables give empty results; extra columns are ignored. Texts of
any length are stored whole.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.llm.common import stored, table

SAMPLE = 64
SAMPLES_PER_CHUNK = 256
TIMESCALE = 8000
#: Fixed values of the format: boxes that only hold other boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"moof", b"traf", b"mvex"}


def _box(kind: bytes, *body: bytes) -> bytes:
    data = b"".join(body)
    if len(data) + 8 < 1 << 32:
        return struct.pack(">I4s", len(data) + 8, kind) + data
    return struct.pack(">I4sQ", 1, kind, len(data) + 16) + data


def _full(kind: bytes, version: int, flags: int, *body: bytes) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *body)


def pad(data: bytes) -> bytes:
    """Zeros up to a positive multiple of the sample size."""
    return data + bytes(-len(data) % SAMPLE if data else SAMPLE)


def to_media(payload: bytes) -> bytes:
    """The container of a payload whose length is a positive multiple of the sample size."""
    samples = len(payload) // SAMPLE
    chunks = -(-samples // SAMPLES_PER_CHUNK)
    rest = samples - (chunks - 1) * SAMPLES_PER_CHUNK
    runs = [(1, SAMPLES_PER_CHUNK, 1)] if chunks > 1 else []
    if not runs or rest != SAMPLES_PER_CHUNK:
        runs.append((chunks, rest, 1))
    matrix = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    duration = samples * SAMPLE
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), struct.pack(">HHIHHHHI", 0, 0, 0, 1, 8, 0, 0, TIMESCALE << 16))
    keyframes = np.arange(1, samples + 1, SAMPLES_PER_CHUNK, dtype=">u4")
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp42")

    def moov(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.int64) * SAMPLE * SAMPLES_PER_CHUNK
        wide = len(payload) + 65536 >= 1 << 32
        stbl = _box(
            b"stbl",
            _full(b"stsd", 0, 0, struct.pack(">I", 1), entry),
            _full(b"stts", 0, 0, struct.pack(">III", 1, samples, SAMPLE)),
            _full(b"stss", 0, 0, struct.pack(">I", len(keyframes)), keyframes.tobytes()),
            _full(b"stsc", 0, 0, struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", 0, 0, struct.pack(">II", SAMPLE, samples)),
            _full(b"co64" if wide else b"stco", 0, 0, struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        media = _box(
            b"mdia",
            _full(b"mdhd", 1, 0, struct.pack(">QQIQHH", 0, 0, TIMESCALE, duration, 0x55C4, 0)),
            _full(b"hdlr", 0, 0, bytes(4), b"soun", bytes(12), b"\x00"),
            _box(b"minf", _full(b"smhd", 0, 0, bytes(4)), _box(b"dinf", _full(b"dref", 0, 0, struct.pack(">I", 1), _full(b"url ", 0, 1))), stbl),
        )
        track = _full(b"tkhd", 1, 7, struct.pack(">QQIIQ", 0, 0, 1, 0, duration), bytes(16), matrix, bytes(8))
        head = _full(b"mvhd", 1, 0, struct.pack(">QQIQ", 0, 0, TIMESCALE, duration), struct.pack(">IH", 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", head, _box(b"trak", track, media))

    lead = 16 if len(payload) + 8 >= 1 << 32 else 8
    return ftyp + moov(len(ftyp) + len(moov(0)) + lead) + _box(b"mdat", payload)


def boxes(data: memoryview, start: int = 0, stop: int | None = None) -> Iterator[tuple[bytes, int, int, int]]:
    """(kind, start, body start, stop) of the boxes between two places; stops at a box that isn't whole."""
    stop = len(data) if stop is None else stop
    while start + 8 <= stop:
        size, kind = struct.unpack_from(">I4s", data, start)
        lead = 8
        if size == 1 and start + 16 <= stop:
            size, lead = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = stop - start
        if size < lead or start + size > stop:
            return
        yield kind, start, start + lead, start + size
        start += size


@dataclass
class Box:
    kind: bytes
    start: int
    body: int
    stop: int
    inner: list[Box]

    def all(self, kind: bytes) -> Iterator[Box]:
        for x in self.inner:
            if x.kind == kind:
                yield x
            yield from x.all(kind)

    def one(self, kind: bytes) -> Box:
        found = next(self.all(kind), None)
        if found is None:
            raise ValueError(f"no {kind.decode('latin-1')} box")
        return found


def tree(data: memoryview, start: int, stop: int) -> list[Box]:
    return [Box(kind, at, a, b, tree(data, a, b) if kind in CONTAINERS else []) for kind, at, a, b in boxes(data, start, stop)]


def _numbers(data: memoryview, start: int, count: int, dtype: str = ">u4") -> np.ndarray:
    if start + count * np.dtype(dtype).itemsize > len(data):
        raise ValueError("a table breaks off")
    return np.frombuffer(data, dtype, count, start).astype(np.int64)


def _sample_tables(data: memoryview, trak: Box) -> dict:
    """Codec, times and sample places that a track's own tables tell."""
    u32 = lambda at: struct.unpack_from(">I", data, at)[0]
    head, shape, stsd, stsz, stsc = (trak.one(k).body for k in (b"tkhd", b"mdhd", b"stsd", b"stsz", b"stsc"))
    number = u32(head + 20) if data[head] == 1 else u32(head + 12)
    scale, duration = struct.unpack_from(">IQ", data, shape + 20) if data[shape] == 1 else struct.unpack_from(">II", data, shape + 12)
    codec = bytes(data[stsd + 12 : stsd + 16]).decode("latin-1")
    fixed, samples = struct.unpack_from(">II", data, stsz + 4)
    sizes = np.full(samples, fixed, np.int64) if fixed else _numbers(data, stsz + 12, samples)
    wide = next(trak.all(b"co64"), None)
    at = (wide or trak.one(b"stco")).body
    offsets = _numbers(data, at + 8, u32(at + 4), ">u8" if wide else ">u4")
    runs = _numbers(data, stsc + 8, 3 * u32(stsc + 4)).reshape(-1, 3)
    place = np.zeros(0, np.int64)
    if samples:
        last = np.append(runs[1:, 0], len(offsets) + 1)
        chunk = np.repeat(np.arange(len(offsets)), np.repeat(runs[:, 1], last - runs[:, 0])[: len(offsets)])[:samples]
        if len(chunk) < samples:
            raise ValueError("fewer places than samples")
        reach = np.cumsum(sizes) - sizes
        place = offsets[chunk] + reach - reach[np.searchsorted(chunk, chunk)]
    stss = next(trak.all(b"stss"), None)
    keys = _numbers(data, stss.body + 8, u32(stss.body + 4)) - 1 if stss else np.arange(samples)
    keys = keys[(keys >= 0) & (keys < samples)]
    return {"number": number, "codec": codec, "timescale": scale, "duration": duration, "samples": samples, "chunks": len(offsets), "offsets": place, "sizes": sizes, "keys": keys}


#: Fixed values of the format: flag bits of tfhd and trun that say which fields follow, in the fields' order.
_BASE, _TFHD, _TRUN = 0x1, (0x2, 0x8, 0x10, 0x20), (0x100, 0x200, 0x400, 0x800)
_FROM_MOOF, _OFFSET, _FIRST_FLAGS, _NOT_SYNC = 0x20000, 0x1, 0x4, 0x10000


def _add_fragments(data: memoryview, top: list[Box], track: dict, defaults: list[int]) -> None:
    """Adds the samples that movie fragments have of a track; defaults: duration, size and flags where they name none."""
    offsets, sizes, keys, duration, done = [track["offsets"]], [track["sizes"]], [track["keys"]], track["duration"], track["samples"]
    for moof in (x for x in top if x.kind == b"moof"):
        end = moof.start
        for traf in moof.all(b"traf"):
            head = traf.one(b"tfhd").body
            flags, number = struct.unpack_from(">II", data, head)
            at, base = head + 8, moof.start if flags & _FROM_MOOF else end
            if flags & _BASE:
                base, at = struct.unpack_from(">Q", data, at)[0], at + 8
            own = [None, *defaults]
            for k, bit in enumerate(_TFHD):
                if flags & bit:
                    own[k], at = struct.unpack_from(">I", data, at)[0], at + 4
            end = base
            for trun in traf.all(b"trun"):
                bits, n = struct.unpack_from(">II", data, trun.body)
                at, first_flags = trun.body + 8, None
                if bits & _OFFSET:
                    end, at = base + struct.unpack_from(">i", data, at)[0], at + 4
                if bits & _FIRST_FLAGS:
                    first_flags, at = struct.unpack_from(">I", data, at)[0], at + 4
                fields = [b for b in _TRUN if bits & b]
                if at + 4 * n * len(fields) > trun.stop:
                    if number == track["number"]:
                        raise ValueError("a run breaks off")
                    break
                rows = dict(zip(fields, _numbers(data, at, n * len(fields)).reshape(n, -1).T, strict=True)) if fields else {}
                took, size, kind = (rows.get(b, np.full(n, x, np.int64)) for b, x in zip(_TRUN, own[1:], strict=False))
                if first_flags is not None and n:
                    kind = np.append(first_flags, kind[1:])
                if number == track["number"]:
                    offsets.append(end + np.cumsum(size) - size)
                    sizes.append(size)
                    keys.append(done + np.flatnonzero((kind & _NOT_SYNC) == 0))
                    done, duration = done + n, duration + int(took.sum())
                    track["chunks"] += 1
                end += int(size.sum())
    track |= {"offsets": np.concatenate(offsets), "sizes": np.concatenate(sizes), "keys": np.concatenate(keys), "duration": duration, "samples": done}


def probe(media: bytes) -> list[dict]:
    """The tracks of a file with their samples and keyframes (byte ranges: start, size)."""
    data, tracks = memoryview(media), []
    top = tree(data, 0, len(data))
    for moov in (x for x in top if x.kind == b"moov"):
        for trak in moov.all(b"trak"):
            try:
                track = _sample_tables(data, trak)
                trex = {struct.unpack_from(">I", data, x.body + 4)[0]: list(struct.unpack_from(">III", data, x.body + 12)) for x in moov.all(b"trex")}
                _add_fragments(data, top, track, trex.get(track["number"], [0, 0, 0]))
            except (struct.error, IndexError, ValueError):
                continue
            keys = track.pop("keys")
            tracks.append(track | {"keyframes": np.stack([track["offsets"][keys], track["sizes"][keys]], 1)})
    return tracks


def payload(media: bytes, track: dict) -> bytes:
    """The samples' bytes in order; samples that lie side by side are read as one range."""
    place, size = track["offsets"], track["sizes"]
    if not len(place):
        return b""
    breaks = np.flatnonzero(place[1:] != place[:-1] + size[:-1]) + 1
    starts, stops = np.append(0, breaks), np.append(breaks, len(place)) - 1
    return b"".join(media[place[a] : place[b] + size[b]] for a, b in zip(starts, stops, strict=True))


def feature(track: dict) -> str:
    """What the tables say, as text: codec, duration in ms, samples, chunks, and the keyframes' byte ranges (a range
    a-b for the first and the last, and a checksum of all)."""
    keys = track["keyframes"]
    ranges = "".join(f"{a}-{a + n};" for a, n in keys.tolist())
    ends = ranges.split(";")
    return (
        f"codec={track['codec'].strip()} ms={track['duration'] * 1000 // max(1, track['timescale'])} samples={track['samples']} chunks={track['chunks']} "
        f"keyframes={len(keys)} first={ends[0]} last={ends[-2] if len(ends) > 1 else ''} ranges_crc32={zlib.crc32(ranges.encode())}"
    )


def media_column(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text in its container."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                texts = batch.column(1).slice(a, 256).to_pylist()
                media = [to_media(pad(x or b"")) for x in texts]
                yield pa.record_batch([batch.column(0).slice(a, 256), pa.array([len(x or b"") for x in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text")).mapInArrow(store, "doc_id bigint, n_bytes bigint, media binary")


_RANGES = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_TRACKS = pa.list_(pa.struct([("codec", pa.string()), ("timescale", pa.int64()), ("duration_ms", pa.int64()), ("samples", pa.int64()), ("keyframes", _RANGES)]))
PROBED = [
    ("doc_id", "bigint", pa.int64()), ("n_bytes", "bigint", pa.int64()), ("payload_bytes", "bigint", pa.int64()), ("payload_sha256", "string", pa.string()),
    ("tail_crc32", "bigint", pa.int64()), ("media_bytes", "bigint", pa.int64()), ("media_sha256", "string", pa.string()), ("feature", "string", pa.string()),
    ("tracks", "array<struct<codec: string, timescale: bigint, duration_ms: bigint, samples: bigint, keyframes: array<struct<start: bigint, stop: bigint>>>>", _TRACKS),
]


def _summary(track: dict) -> dict:
    ms = track["duration"] * 1000 // max(1, track["timescale"])
    return {"codec": track["codec"].strip(), "timescale": track["timescale"], "duration_ms": ms, "samples": track["samples"], "keyframes": [{"start": a, "stop": a + n} for a, n in track["keyframes"].tolist()]}


def probe_media(media: DataFrame) -> DataFrame:
    """Digests of the first track's payload and the tables of all tracks (codec, times, keyframes' byte ranges) of a media column."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                rows = []
                for doc_id, n, m in zip(*(batch.column(k).slice(a, 256).to_pylist() for k in range(3)), strict=True):
                    tracks = probe(m)
                    p = payload(m, tracks[0]) if tracks else None
                    digests = (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-SAMPLE:])) if tracks else (None,) * 3
                    rows.append((doc_id, n, *digests, len(m), hashlib.sha256(m).hexdigest(), feature(tracks[0]) if tracks else None, [_summary(t) for t in tracks]))
                yield pa.record_batch([pa.array(c, k) for c, (_, _, k) in zip(zip(*rows, strict=True), PROBED, strict=True)], names=[name for name, _, _ in PROBED])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, ", ".join(f"{name} {kind}" for name, kind, _ in PROBED))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = probe_media(stored(media_column(table(spark, sf_dir, "documents")), "media"))
    first = F.get("tracks", F.lit(0))
    return found.withColumns({"codec": first["codec"], "duration_ms": first["duration_ms"], "keyframes": first["keyframes"], "n_tracks": F.size("tracks")}).drop("tracks")
