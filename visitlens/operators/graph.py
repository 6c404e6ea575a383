"""Connected components by stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.sources.storage import saved


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours linked to the least it knows, then what each node is linked to linked to the least of it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(least.hint("merge"), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _ordered(moved.unionByName(least.withColumnRenamed("m", "v")))


def min_label_components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of all nodes (id), component the least id that can be reached by edges (u, v), either way.

    Large and small stars in turn: the number of edges never grows and the rounds are logarithmic in the nodes. A round's
    edges are written to the shared folder, which bounds the lineage and survives a lost executor. Joins are by sorted shuffles: a
    broadcast of each round would stay on the driver.
    """
    now, state = saved(_ordered(edges), "edges"), None
    for _ in range(rounds):
        now = saved(_star(now), "edges")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == state:
            break
        state = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    return nodes.distinct().join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
