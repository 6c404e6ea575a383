"""Directed edges chained into rings, by joins and doubling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlens.sources.storage import saved


def _turn(e: str, f: str) -> Column:
    """Angle from edge e to edge f, to the left positive."""
    dx, dy = (lambda k: F.col(f"{k}x2") - F.col(f"{k}x1")), (lambda k: F.col(f"{k}y2") - F.col(f"{k}y1"))
    return F.atan2(dx(e) * dy(f) - dy(e) * dx(f), dx(e) * dx(f) + dy(e) * dy(f))


def chained(edges: DataFrame, key: str, rounds: int = 60) -> DataFrame:
    """edges (key, x1, y1, x2, y2) with (ring, hops, corner): the ring that each is part of, its edges to go to the ring's
    first one, and whether the next one turns off.

    What is bounded lies to the left of its edges, and as many edges end in a point as begin there. Where several go on, the
    leftmost does, so parts that touch in a point have rings of their own. In each round an edge looks twice as far along its
    ring, so rounds are logarithmic in the longest ring's length, and no task holds a ring.
    """
    numbered = saved(edges.select(key, "x1", "y1", "x2", "y2", F.monotonically_increasing_id().alias("id")), "edges")
    e = numbered.select(key, *(F.col(c).alias(f"e{c}") for c in ("x1", "y1", "x2", "y2")), F.col("id").alias("e"), F.col("x2").alias("x"), F.col("y2").alias("y"))
    f = numbered.select(key, *(F.col(c).alias(f"f{c}") for c in ("x1", "y1", "x2", "y2")), F.col("id").alias("f"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    pairs = e.join(f, [key, "x", "y"]).select("e", "f", _turn("e", "f").alias("turn"))
    on = pairs.groupBy("e").agg(F.max(F.struct("turn", F.col("f").alias("next"))).alias("on"))
    first = on.select(F.col("e").alias("id"), F.col("on.next").alias("next"), (F.abs("on.turn") > 1e-9).alias("corner"))
    corners = saved(first.select("id", "corner"), "corners")
    state, window = saved(first.select("id", "next", F.col("id").alias("least"), F.lit(0).cast("bigint").alias("hops")), "chain"), 1
    for _ in range(rounds):
        further = state.select(F.col("id").alias("next"), F.col("next").alias("then"), F.col("least").alias("other"), F.col("hops").alias("more"))
        lower = F.col("other") < F.col("least")
        hops = F.when(lower, F.lit(window) + F.col("more")).otherwise(F.col("hops"))
        moved = state.join(further, "next").select("id", F.col("then").alias("next"), F.least("least", "other").alias("least"), hops.alias("hops"), lower.alias("lower"))
        moved = saved(moved, "chain")
        state, window = moved.drop("lower"), window * 2
        if moved.where("lower").isEmpty():
            break
    else:
        raise RuntimeError(f"rings did not close in {rounds} rounds")
    return numbered.join(corners, "id").join(state.select("id", F.col("least").alias("ring"), "hops"), "id").drop("id")


def rings(edges: DataFrame, key: str) -> DataFrame:
    """(key, ring, area, length, corners, xs, ys) of directed edges: area is negative for holes; xs and ys are the corners in turn."""
    c = chained(edges, key)
    at = F.when(F.col("corner"), F.struct((-F.col("hops")).alias("at"), F.col("x2").alias("x"), F.col("y2").alias("y")))
    x1, y1, x2, y2 = (F.col(n) for n in ("x1", "y1", "x2", "y2"))
    shape = c.groupBy(key, "ring").agg(
        (F.sum((x2 - x1) * (y1 + y2)) / -2).alias("area"), F.sum(F.hypot(x2 - x1, y2 - y1)).alias("length"), F.count_if("corner").alias("corners"), F.array_sort(F.collect_list(at)).alias("at")
    )
    return shape.select(key, "ring", "area", "length", "corners", F.col("at.x").alias("xs"), F.col("at.y").alias("ys"))


def ring_text(xs: Column, ys: Column, digits: int = 6) -> Column:
    """The corners as the inside of a ring in text form, closed."""
    point = F.transform(F.arrays_zip(xs.alias("x"), ys.alias("y")), lambda p: F.concat_ws(" ", F.round(p["x"], digits).cast("string"), F.round(p["y"], digits).cast("string")))
    return F.concat(F.lit("("), F.array_join(F.concat(point, F.slice(point, 1, 1)), ", "), F.lit(")"))


def region_edges(pixels: DataFrame) -> DataFrame:
    """(region, x1, y1, x2, y2): unit edges of pixels (region, row, col) that no two pixels of one region share, the region to
    the left; a pixel's corner nearest to the origin is (col, row)."""
    corner = lambda dx, dy: F.struct((F.col("col") + dx).cast("double").alias("x"), (F.col("row") + dy).cast("double").alias("y"))
    turn = (corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))
    sides = F.array(*(F.struct(turn[i].alias("a"), turn[(i + 1) % 4].alias("b")) for i in range(4)))
    edges = pixels.select("region", F.explode(sides).alias("s")).select("region", "s.a", "s.b")
    alone = edges.groupBy("region", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.count("*").alias("n"), F.first("a").alias("a"), F.first("b").alias("b")).where("n = 1")
    return alone.select("region", *(F.col(f"{p}.{c}").alias(f"{c}{k}") for k, p in ((1, "a"), (2, "b")) for c in ("x", "y")))
