"""Unions of polygons by their edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlens.sources.storage import saved

POINTS = ("x1", "y1", "x2", "y2")


def inside(x: Column, y: Column, xs: Column, ys: Column) -> Column:
    """Whether a point is in a ring, by the number of edges to its right."""
    n = F.size(xs)

    def crossed(i: Column) -> Column:
        j = (i + 1) % n
        xi, yi, xj, yj = F.get(xs, i), F.get(ys, i), F.get(xs, j), F.get(ys, j)
        return ((yi > y) != (yj > y)) & (x < (xj - xi) * (y - yi) / F.nullif(yj - yi, F.lit(0.0)) + xi)

    hits = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(crossed(i), F.lit(False)))
    return F.size(hits) % 2 == 1


def signed_area(xs: Column, ys: Column) -> Column:
    n = F.size(xs)
    step = lambda s, i: s + (F.get(xs, i) - F.get(xs, F.lit(0))) * (F.get(ys, (i + 1) % n) - F.get(ys, (i + n - 1) % n))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), step) / 2


def _segments(polygons: DataFrame, key: str, grain: float) -> DataFrame:
    """(key, polygon, sid, x1, y1, x2, y2): edges of rings (key, polygon, xs, ys) on a lattice of `grain`, the inside to the left."""
    on = lambda c: F.transform(c, lambda v: F.round(v / grain) * grain)
    p = polygons.select(key, "polygon", on(F.col("xs")).alias("xs"), on(F.col("ys")).alias("ys"))
    p = p.withColumn("is_left", signed_area(F.col("xs"), F.col("ys")) >= 0)
    p = p.select(key, "polygon", *(F.when(F.col("is_left"), F.col(c)).otherwise(F.reverse(c)).alias(c) for c in ("xs", "ys")))
    n = F.size("xs")
    edges = p.select(key, "polygon", "xs", "ys", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    at = lambda c, i: F.get(F.col(c), i % F.size("xs"))
    cut = edges.select(key, "polygon", at("xs", F.col("i")).alias("x1"), at("ys", F.col("i")).alias("y1"), at("xs", F.col("i") + 1).alias("x2"), at("ys", F.col("i") + 1).alias("y2"))
    return cut.where("x1 <> x2 OR y1 <> y2").withColumn("sid", F.monotonically_increasing_id())


def _in_buckets(rows: DataFrame, size: float, x: tuple[Column, Column], y: tuple[Column, Column], margin: float = 0.0) -> DataFrame:
    """rows in each bucket (a, b) that the box between x and y, and a margin, reach."""
    bucket = lambda c: F.floor(c / size).cast("bigint")
    span = lambda low, high: F.explode(F.sequence(bucket(low - margin), bucket(high + margin)))
    return rows.select("*", span(*x).alias("a")).select("*", span(*y).alias("b"))


def _meetings(segments: DataFrame, key: str, size: float, grain: float) -> DataFrame:
    """(sid, x, y): the points where a segment is crossed, touched or met along a stretch by another of its key."""
    x = (F.least("x1", "x2"), F.greatest("x1", "x2"))
    y = (F.least("y1", "y2"), F.greatest("y1", "y2"))
    dealt = _in_buckets(segments, size, x, y, grain)
    # A long slanting segment passes only some of the buckets of its box.
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    off = F.abs(dx * ((F.col("b") + 0.5) * size - F.col("y1")) - dy * ((F.col("a") + 0.5) * size - F.col("x1")))
    dealt = dealt.where(off <= (size * 0.5 + grain) * (F.abs(dx) + F.abs(dy)))
    p = dealt.select(key, "a", "b", *(F.col(c).alias(f"p_{c}") for c in ("sid", *POINTS)))
    q = dealt.select(key, "a", "b", *(F.col(c).alias(f"q_{c}") for c in ("sid", *POINTS)))
    c = lambda name: F.col(name)
    rx, ry, sx, sy = c("p_x2") - c("p_x1"), c("p_y2") - c("p_y1"), c("q_x2") - c("q_x1"), c("q_y2") - c("q_y1")
    wx, wy = c("q_x1") - c("p_x1"), c("q_y1") - c("p_y1")
    cross = rx * sy - ry * sx
    pairs = p.join(q, [key, "a", "b"]).where("p_sid < q_sid").dropDuplicates(["p_sid", "q_sid"])
    pairs = pairs.withColumns({"cross": cross, "t": (wx * sy - wy * sx) / F.nullif(cross, F.lit(0.0)), "u": (wx * ry - wy * rx) / F.nullif(cross, F.lit(0.0))})
    slack = lambda k: grain / F.hypot(c(f"{k}_x2") - c(f"{k}_x1"), c(f"{k}_y2") - c(f"{k}_y1"))
    on = lambda v, k: (v >= -slack(k)) & (v <= 1 + slack(k))
    crossing = F.struct((c("p_x1") + c("t") * rx).alias("x"), (c("p_y1") + c("t") * ry).alias("y"))
    ends = [F.struct(c(f"{k}_x{i}").alias("x"), c(f"{k}_y{i}").alias("y")) for k in "pq" for i in (1, 2)]
    near = lambda m, e: F.hypot(m["x"] - e["x"], m["y"] - e["y"]) <= 2 * grain
    snapped = F.struct((F.round(crossing["x"] / grain) * grain).alias("x"), (F.round(crossing["y"] / grain) * grain).alias("y"))
    point = F.coalesce(*(F.when(near(crossing, e), e) for e in ends), snapped)
    met = pairs.where("cross <> 0").where(on(c("t"), "p") & on(c("u"), "q")).select("p_sid", "q_sid", point.alias("m"))

    def between(e: Column, k: str) -> Column:
        """Whether a point lies on the line of segment k and between its ends."""
        x1, y1, x2, y2 = (c(f"{k}_{n}") for n in POINTS)
        ax, ay, bx, by = x2 - x1, y2 - y1, e["x"] - x1, e["y"] - y1
        size2 = ax * ax + ay * ay
        return (F.abs(ax * by - ay * bx) <= grain * F.sqrt(size2)) & (ax * bx + ay * by >= 0) & (ax * bx + ay * by <= size2)

    along = pairs.where("cross = 0").select("p_sid", "q_sid", F.filter(F.array(*(F.when(between(e, k), F.struct(F.lit(k).alias("k"), e.alias("m"))) for k, es in (("p", ends[2:]), ("q", ends[:2])) for e in es)), lambda v: v.isNotNull()).alias("ms"))
    along = along.select("p_sid", "q_sid", F.explode("ms").alias("v")).select(F.when(F.col("v.k") == "p", F.col("p_sid")).otherwise(F.col("q_sid")).alias("sid"), "v.m")
    both = met.select(F.col("p_sid").alias("sid"), "m").unionByName(met.select(F.col("q_sid").alias("sid"), "m")).unionByName(along)
    return both.distinct()


def union_edges(polygons: DataFrame, key: str, size: float, grain: float = 1e-9) -> DataFrame:
    """(key, x1, y1, x2, y2): the boundary of the union of each key's polygons, what is covered to the left of its edges.

    polygons: (key, polygon, xs, ys), simple rings that turn either way. Their edges are cut where others of the key cross or
    touch them, found in buckets of `size`; stretches that two polygons have in common stay once if both lie to the same side
    and go if they lie to either side; the rest stays where no other polygon covers its middle. Coordinates are rounded to
    `grain`.
    """
    segments = saved(_segments(polygons.where(F.size("xs") > 2), key, grain), "segments")
    points = _meetings(segments, key, size, grain).groupBy("sid").agg(F.collect_set("m").alias("ms"))
    s = segments.join(points, "sid", "left")
    start, end = (F.struct(F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")) for i in (1, 2))
    along = lambda m: (m["x"] - F.col("x1")) * (F.col("x2") - F.col("x1")) + (m["y"] - F.col("y1")) * (F.col("y2") - F.col("y1"))
    stops = F.array_distinct(F.concat(F.array(start), F.coalesce("ms", F.array().cast("array<struct<x:double,y:double>>")), F.array(end)))
    order = F.transform(F.array_sort(F.transform(stops, lambda m: F.struct(along(m).alias("t"), m.alias("m")))), lambda v: v["m"])
    cut = s.select(key, "polygon", order.alias("o")).select(key, "polygon", F.explode(F.transform(F.sequence(F.lit(0), F.size("o") - 2), lambda i: F.struct(F.get("o", i).alias("a"), F.get("o", i + 1).alias("b")))).alias("e"))
    forward = F.col("e.a") < F.col("e.b")
    low, high = F.least("e.a", "e.b").alias("low"), F.greatest("e.a", "e.b").alias("high")
    shared = cut.groupBy(key, low, high).agg(F.max(forward).alias("up"), F.max(~forward).alias("down"), F.collect_set("polygon").alias("owners"))
    single = saved(shared.where("up <> down").withColumns({"mx": (F.col("low.x") + F.col("high.x")) / 2, "my": (F.col("low.y") + F.col("high.y")) / 2}), "pieces")
    box = lambda c: (F.array_min(c), F.array_max(c))
    covers = _in_buckets(polygons.select(key, "polygon", "xs", "ys"), size, box("xs"), box("ys")).withColumnRenamed(key, "own_key")
    placed = single.withColumns({"pa": F.floor(F.col("mx") / size).cast("bigint"), "pb": F.floor(F.col("my") / size).cast("bigint")})
    within = (F.col(key) == F.col("own_key")) & (F.col("pa") == F.col("a")) & (F.col("pb") == F.col("b"))
    hidden = within & ~F.array_contains("owners", F.col("polygon")) & inside(F.col("mx"), F.col("my"), F.col("xs"), F.col("ys"))
    bare = placed.join(covers, hidden, "left_anti")
    one, two = F.when(F.col("up"), F.col("low")).otherwise(F.col("high")), F.when(F.col("up"), F.col("high")).otherwise(F.col("low"))
    return bare.select(key, one["x"].alias("x1"), one["y"].alias("y1"), two["x"].alias("x2"), two["y"].alias("y2"))
