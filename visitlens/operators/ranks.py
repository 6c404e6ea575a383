"""Ranks and percentiles of values that no task could hold, from counts of distinct ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitlens.sources.storage import saved


def running_counts(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, count, upto): how often each value that isn't null stands in a key's rows, and how many are no greater.

    Counts are dealt to tasks by ranges of key and value; each task runs over its own, and the sums of a key's earlier tasks
    are added, which are one row for each task and key.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("count"))
    dealt = counts.repartitionByRange(key, value).withColumn("part", F.spark_partition_id())
    own = Window.partitionBy("part", key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    within = saved(dealt.withColumn("within", F.sum("count").over(own)), "counts")
    parts = within.groupBy(key, "part").agg(F.sum("count").alias("part_sum"))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select(F.col(key).alias("of_key"), F.col("part").alias("of_part"), F.coalesce(F.sum("part_sum").over(before), F.lit(0)).alias("base"))
    same = F.col(key).eqNullSafe(F.col("of_key")) & (F.col("part") == F.col("of_part"))
    return within.join(bases, same).select(key, value, "count", (F.col("within") + F.col("base")).alias("upto"))


def counted_percentiles(rows: DataFrame, key: str, value: str, points: list[float], name: str = "percentiles") -> DataFrame:
    """(key, name): an array of the exact percentiles at points between 0 and 1, linear between neighbouring ranks."""
    counts = running_counts(rows, key, value)
    total = counts.groupBy(F.col(key).alias("of_key")).agg(F.sum("count").alias("total"))
    at = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(points))))
    rank = F.col("asked.p") * (F.col("total") - 1)
    asked = total.select("of_key", "total", at.alias("asked")).select("of_key", F.col("asked.i").alias("i"), F.floor(rank).alias("low"), F.ceil(rank).alias("high"), (rank - F.floor(rank)).alias("share"))
    # A value has the ranks from upto - count to upto - 1: few questions meet all counts of their key.
    covers = lambda r: (F.col(r) >= F.col("upto") - F.col("count")) & (F.col(r) < F.col("upto"))
    hit = counts.join(asked, F.col(key).eqNullSafe(F.col("of_key")) & (covers("low") | covers("high")))
    part = hit.groupBy("of_key", "i").agg(F.max(F.when(covers("low"), F.col(value))).alias("a"), F.max(F.when(covers("high"), F.col(value))).alias("b"), F.first("share").alias("s"))
    own = F.struct("i", (F.col("a") + F.col("s") * (F.col("b") - F.col("a"))).alias("v"))
    return part.groupBy(F.col("of_key").alias(key)).agg(F.transform(F.array_sort(F.collect_list(own)), lambda x: x["v"]).alias(name))


def numbered(rows: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """rows with their place from 0 in an order: ranges of it are numbered in tasks of their own, then the sizes of earlier ones added."""
    dealt = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    own = saved(dealt.withColumn(name, F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1), "numbered")
    sizes = own.groupBy("part").agg(F.count("*").alias("part_sum"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each task
    bases = sizes.select("part", F.coalesce(F.sum("part_sum").over(before), F.lit(0)).alias("base"))
    return own.join(bases, "part").withColumn(name, F.col(name) + F.col("base")).drop("part", "base")
