"""Rasters and shapefiles as data sources, traced regions and unions of polygons, against plain Python."""

import struct
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from visitlens.operators.outline import concave_edges
from visitlens.operators.rings import region_edges, rings
from visitlens.plans.shapes import raster_files, united
from visitlens.sources import tiff
from visitlens.sources.shapefile import ShapefileSource, rings_of, shape_of

SF_DIR = "/root/testdata/sf0.001"


def tiff_file(pixels, order="<", big=False, tiles=None, compression=1, predictor=1, none=None, extra=()):
    """A raster file made by hand: strips of three rows, or tiles."""
    h, w = pixels.shape
    code = {"u": 1, "i": 2, "f": 3}[pixels.dtype.kind]
    pixels = pixels.astype(pixels.dtype.newbyteorder(order))
    blocks = []
    if tiles:
        th, tw = tiles
        for r in range(0, h, th):
            for c in range(0, w, tw):
                b = np.zeros((th, tw), pixels.dtype)
                part = pixels[r : r + th, c : c + tw]
                b[: part.shape[0], : part.shape[1]] = part
                blocks.append(b)
    else:
        blocks = [pixels[r : r + 3] for r in range(0, h, 3)]
    data = []
    for b in blocks:
        if predictor == 2:
            b = np.concatenate([b[:, :1], np.diff(b, axis=1)], axis=1).astype(pixels.dtype)
        raw = b.tobytes()
        if predictor == 3:
            planes = b.astype(pixels.dtype.newbyteorder(">")).view(np.uint8).reshape(*b.shape, -1).transpose(0, 2, 1).reshape(len(b), -1)
            raw = np.concatenate([planes[:, :1], np.diff(planes, axis=1)], axis=1).astype(np.uint8).tobytes()
        data.append({1: bytes, 8: zlib.compress, 5: lzw}[compression](raw))
    head, num = (16, "Q") if big else (8, "I")
    at = np.cumsum([head, *map(len, data)]).tolist()
    tags = [(256, "H", [w]), (257, "H", [h]), (258, "H", [pixels.dtype.itemsize * 8]), (259, "H", [compression]), (317, "H", [predictor]), (339, "H", [code])]
    tags += [(322, "H", [tiles[1]]), (323, "H", [tiles[0]]), (324, num, at[:-1]), (325, num, [len(x) for x in data])] if tiles else [(273, num, at[:-1]), (278, "H", [3]), (279, num, [len(x) for x in data])]
    tags += [(42113, "s", none)] if none else []
    tags = sorted([*tags, *extra])
    kinds = {"H": 3, "I": 4, "Q": 16, "d": 12, "s": 2}
    place, room = at[-1], 8 if big else 4
    size = (8 if big else 2) + len(tags) * (20 if big else 12) + room
    entries, beyond = b"", b""
    for tag, kind, values in tags:
        raw = values if kind == "s" else struct.pack(f"{order}{len(values)}{kind}", *values)
        entries += struct.pack(f"{order}HH{num}", tag, kinds[kind], len(values))
        entries += raw.ljust(room, b"\0") if len(raw) <= room else struct.pack(f"{order}{num}", place + size + len(beyond))
        beyond += raw if len(raw) > room else b""
    start = struct.pack(f"{order}2sH", b"II" if order == "<" else b"MM", 43 if big else 42) + (struct.pack(f"{order}HHQ", 8, 0, place) if big else struct.pack(f"{order}I", place))
    return start + b"".join(data) + struct.pack(f"{order}{'Q' if big else 'H'}", len(tags)) + entries + struct.pack(f"{order}{num}", 0) + beyond


def lzw(data):
    """Codes of 9 to 12 bits, most significant bit first."""
    out, bits, held = bytearray(), 0, 0

    def put(code, width):
        nonlocal bits, held
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    table, width, word = {bytes([i]): i for i in range(256)}, 9, b""
    put(256, 9)
    for b in data:
        longer = word + bytes([b])
        if longer in table:
            word = longer
            continue
        put(table[word], width)
        table[longer] = len(table) + 2
        width = max(width, (len(table) + 2).bit_length())
        if len(table) + 2 >= 4094:
            put(256, width)
            table, width = {bytes([i]): i for i in range(256)}, 9
        word = bytes([b])
    if word:
        put(table[word], width)
        if (len(table) + 3).bit_length() > width:
            width += 1
    put(257, width)
    put(0, 7)
    return bytes(out)


GEO = [(33550, "d", [0.5, 0.25, 0.0]), (33922, "d", [0, 0, 0, 10.0, 50.0, 0])]


@pytest.mark.parametrize(
    ("dtype", "how"),
    [("u1", {}), ("i2", {"order": ">"}), ("u4", {"big": True}), ("f4", {"tiles": (16, 16), "compression": 8}), ("f8", {"compression": 5}), ("i4", {"compression": 8, "predictor": 2}), ("f4", {"tiles": (16, 32), "compression": 5, "predictor": 3}), ("u2", {"order": ">", "big": True, "compression": 5, "predictor": 2})],
)
def test_rasters_of_every_kind(spark, tmp_path, dtype, how):
    pixels = np.random.default_rng(1).integers(0, 100, (23, 41)).astype(dtype)
    (tmp_path / "a.tif").write_bytes(tiff_file(pixels, none=b"7\0", extra=GEO, **how))
    tiff.register(spark)
    got = {(r.row, r.col): r for r in spark.read.format("tiff").load(f"file://{tmp_path}/a.tif").collect()}
    assert {k: r.value for k, r in got.items()} == {(i, j): float(v) for (i, j), v in np.ndenumerate(pixels) if v != 7}
    assert all((r.x, r.y) == (10 + (r.col + 0.5) * 0.5, 50 - (r.row + 0.5) * 0.25) for r in got.values())


def test_a_window_of_a_raster_reads_its_strips_only(spark):
    r = spark.read.format("tiff").option("bytes", 1).load(raster_files(spark, SF_DIR))
    every, some = r.rdd.getNumPartitions(), r.where("row = 2 AND col < 16").rdd.getNumPartitions()
    assert some == 1 < every
    assert r.where("row = 2 AND col < 16").count() == r.toPandas().query("row == 2 and col < 16").shape[0]
    assert r.where("row > 10000").count() == 0
    assert spark.read.format("tiff").option("bytes", 1 << 20).load(raster_files(spark, SF_DIR)).rdd.getNumPartitions() < every


def test_raster_writing_leaves_whole_files_only(spark, tmp_path):
    tiff.register(spark)
    rows = spark.createDataFrame([(-3, 5, 1.5), (0, 0, None), (40, 2, 2.5)], "row long, col long, value double")
    rows.coalesce(1).write.format("tiff").option("path", str(tmp_path)).option("block", 16).mode("append").save()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["-1-0.tif", "0-0.tif", "2-0.tif"]
    assert sorted(map(tuple, spark.read.format("tiff").load(str(tmp_path)).select("row", "col", "value").collect())) == [(-3, 5, 1.5), (40, 2, 2.5)]
    with pytest.raises(Exception, match="more than one task"):
        spark.range(4).selectExpr("id AS row", "id AS col", "1D AS value").repartition(4, "row").write.format("tiff").option("path", f"{tmp_path}/b").mode("append").save()


SQUARE, HOLE = {"hole": False, "xs": [0.0, 0.0, 4.0, 4.0], "ys": [0.0, 4.0, 4.0, 0.0]}, {"hole": True, "xs": [1.0, 2.0, 2.0], "ys": [1.0, 1.0, 2.0]}
ISLAND, FAR = {"hole": False, "xs": [1.5, 1.75, 1.75], "ys": [1.25, 1.25, 1.5]}, {"hole": False, "xs": [9.0, 10.0, 9.5], "ys": [0.0, 0.0, 1.0]}


def test_holes_belong_to_the_least_ring_around_them():
    got = rings_of(shape_of([FAR, SQUARE, HOLE, ISLAND]))
    assert [(part, hole, sorted(zip(xs, ys))) for part, hole, xs, ys in got] == [(p, r["hole"], sorted(zip(r["xs"], r["ys"]))) for p, r in ((0, FAR), (1, SQUARE), (1, HOLE), (2, ISLAND))]


def test_shapefile_attributes_come_back(spark, tmp_path):
    spark.dataSource.register(ShapefileSource)
    rows = [(1, "Wörd", 1.5, True, [SQUARE, HOLE]), (None, None, None, None, []), (-7, "", -0.1, False, [FAR]), (10**17, "x" * 100, 1e-300, None, None)]
    kinds = "n long, name string, v double, ok boolean, rings array<struct<hole: boolean, xs: array<double>, ys: array<double>>>"
    spark.createDataFrame(rows, kinds).repartition(2).write.format("shapefile").option("path", str(tmp_path)).mode("append").save()
    s = spark.read.format("shapefile").option("records", 1).load(str(tmp_path))
    assert s.rdd.getNumPartitions() == 4 and len(list(tmp_path.glob("*.shp"))) <= 2
    got = {(r.n, r["name"], r.v, r.ok, sum(not x.hole for x in r.rings), sum(x.hole for x in r.rings)) for r in s.collect()}
    assert got == {(1, "Wörd", 1.5, True, 1, 1), (None, None, None, None, 0, 0), (-7, None, -0.1, False, 1, 0), (10**17, "x" * 100, 1e-300, None, 0, 0)}


def test_regions_with_holes_and_corners_that_touch(spark):
    picture = ["####.#", "#..#.#", "#.##..", "####.#", "....#."]
    pixels = [(1, r, c) for r, line in enumerate(picture) for c, x in enumerate(line) if x == "#"]
    got = rings(region_edges(spark.createDataFrame(pixels, "region long, row long, col long")), "region").collect()
    assert sum(r.area for r in got) == len(pixels) and sorted(r.area for r in got) == [-3.0, 1.0, 1.0, 2.0, 16.0]
    for r in got:
        x, y = np.array(r.xs), np.array(r.ys)
        assert np.isclose((np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2, r.area) and len(x) == r.corners


def test_union_of_slanting_polygons(spark):
    """Areas by sampled points: triangles and quadrangles in any direction, some equal, some sharing an edge."""
    g = np.random.default_rng(2)
    shapes = []
    for key in range(3):
        for i in range(14):
            at, turn = g.random(2) * 4, np.sort(g.random(3 + i % 2) * 2 * np.pi)
            shapes.append((key, i, at + 1.2 * np.stack([np.cos(turn), np.sin(turn)], 1)))
        shapes += [(key, 20, shapes[-1][2][::-1]), (key, 21, np.array([[5, 0], [6, 0], [6, 1], [5, 1]])), (key, 22, np.array([[6, 0], [7, 0.5], [6, 1]]))]
    rows = [(k, i, p[:, 0].astype(float).tolist(), p[:, 1].astype(float).tolist()) for k, i, p in shapes]
    got = {r.key: r for r in united(spark.createDataFrame(rows, "key long, polygon long, xs array<double>, ys array<double>"), "key", 0.7).collect()}

    def covered(p, pts):
        x, y, x2, y2 = p[:, 0], p[:, 1], np.roll(p[:, 0], -1), np.roll(p[:, 1], -1)
        up = (y[:, None] > pts[:, 1]) != (y2[:, None] > pts[:, 1])
        return (up & (pts[:, 0] < (x2 - x)[:, None] * (pts[:, 1] - y[:, None]) / np.where(y2 == y, 1, y2 - y)[:, None] + x[:, None])).sum(0) % 2 == 1

    pts = g.random((200_000, 2)) * [9, 7] - [1.5, 1.5]
    for key in range(3):
        hit = np.any([covered(p, pts) for k, _, p in shapes if k == key], axis=0)
        assert abs(hit.mean() * 63 - got[key].area) < 4 * 63 * np.sqrt(0.25 / len(pts))
    assert sorted(got) == [0, 1, 2]


def test_union_of_one_hot_key_is_many_tasks(spark):
    side = lambda corners, at: F.array(*(at.cast("double") + 1.5 * c for c in corners))
    xs, ys = side((0, 1, 1, 0), F.col("id") % 20), side((0, 0, 1, 1), F.floor(F.col("id") / 20))
    boxes = spark.range(400).select(F.lit(1).alias("key"), F.col("id").alias("polygon"), xs.alias("xs"), ys.alias("ys"))
    got = united(boxes, "key", 4.0).first()
    assert (got.area, got.length, got.corners, got.parts, got.holes) == (20.5**2, 4 * 20.5, 4, 1, 0)


def triangles(p):
    """Delaunay triangles by trying all: those whose circumcircle holds no other place; (circumradius, corners to the left)."""
    out = []
    for a in range(len(p)):
        for b in range(a + 1, len(p)):
            for c in range(b + 1, len(p)):
                (x, y), (x1, y1), (x2, y2) = p[a], p[b] - p[a], p[c] - p[a]
                d = 2 * (x1 * y2 - y1 * x2)
                if abs(d) < 1e-12:
                    continue
                u, v = (y2 * (x1**2 + y1**2) - y1 * (x2**2 + y2**2)) / d, (x1 * (x2**2 + y2**2) - x2 * (x1**2 + y1**2)) / d
                r2 = u * u + v * v
                far = (p[:, 0] - x - u) ** 2 + (p[:, 1] - y - v) ** 2
                far[[a, b, c]] = np.inf
                if (far > r2).all():
                    out.append((np.sqrt(r2), (a, b, c) if d > 0 else (a, c, b)))
    return out


@pytest.mark.parametrize("radius", [0.9, 1.4, 50.0])
def test_concave_outline_is_the_edge_of_small_triangles(spark, radius):
    g = np.random.default_rng(7)
    p = np.concatenate([g.random((45, 2)) * [6, 2], g.random((25, 2)) * 2 + [0, 3], [[20.0, 20.0]]])
    small = [t for r, t in triangles(p) if r < radius]
    edges = [e for t in small for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))]
    want = {(*map(float, p[a]), *map(float, p[b])) for a, b in edges if (b, a) not in edges}
    df = spark.createDataFrame([(1, float(x), float(y)) for x, y in p] * 2, "key long, x double, y double").repartition(3)
    got = concave_edges(df, "key", radius)
    assert {tuple(r)[1:] for r in got.collect()} == want and got.count() == len(want)
    shape = rings(got, "key").collect()
    area = sum(abs((p[b] - p[a])[0] * (p[c] - p[a])[1] - (p[b] - p[a])[1] * (p[c] - p[a])[0]) / 2 for a, b, c in small)
    assert np.isclose(sum(r.area for r in shape), area)
    corners = {c for r in shape for c in zip(r.xs, r.ys)}
    used = {tuple(map(float, p[i])) for t in small for i in t}
    for q in used - corners:  # what is no corner lies within, or on a straight side
        assert sum(in_ring(r.xs, r.ys, q) for r in shape) == 1


def in_ring(xs, ys, q):
    x, y, x2, y2 = np.array(xs), np.array(ys), np.roll(xs, -1), np.roll(ys, -1)
    up = (y > q[1]) != (y2 > q[1])
    return bool((up & (q[0] < (x2 - x) * (q[1] - y) / np.where(y2 == y, 1, y2 - y) + x)).sum() % 2)


def test_concave_outline_of_a_lattice(spark):
    """Places on one circle leave no edges within: a full square with a hole, whose own corners hold a triangle each."""
    rows = [(1, float(i), float(j)) for i in range(30) for j in range(30) if not (10 < i < 20 and 10 < j < 20)]
    shape = rings(concave_edges(spark.createDataFrame(rows, "key long, x double, y double"), "key", 1.5), "key").collect()
    assert sorted((r.area, r.corners) for r in shape) == [(-98.0, 8), (841.0, 4)]


def test_small_rasters_share_tasks(spark):
    """Planning opens no small file and puts many into a task; every pixel is read once."""
    from visitlens.plans.shapes import raster_scan
    from visitlens.sources.views import cells

    r = raster_scan(spark, SF_DIR)
    n = cells(spark, SF_DIR).where("population > 0").count()
    assert r.count() == r.select("row", "col").distinct().count() == n and r.rdd.getNumPartitions() == 1


def test_a_shapefile_writer_holds_one_set_of_files(spark, tmp_path, monkeypatch):
    import pyarrow as pa
    from pyspark.sql import types as T

    from visitlens.sources import shapefile

    monkeypatch.setattr(shapefile, "FILE_ROWS", 10, raising=False)
    monkeypatch.setattr(shapefile, "STEP_ROWS", 5, raising=False)
    own = pa.list_(pa.struct([("hole", pa.bool_()), ("xs", pa.list_(pa.float64())), ("ys", pa.list_(pa.float64()))]))
    batches = [pa.record_batch([pa.array(range(a, a + 7)), pa.array([[SQUARE]] * 7, own)], names=["n", "rings"]) for a in range(0, 35, 7)]
    writer = shapefile.ShapefileWriter(str(tmp_path), T.StructType([T.StructField("n", T.LongType()), T.StructField("rings", T.StringType())]))
    writer.commit([writer.write(iter(batches))])
    assert len(list(tmp_path.glob("*.shp"))) == 3
    spark.dataSource.register(ShapefileSource)
    assert sorted(r.n for r in spark.read.format("shapefile").load(str(tmp_path)).collect()) == list(range(35))
