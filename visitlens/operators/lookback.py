"""Distinct members within a trailing range of days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distinct_in_range(sights: DataFrame, at: DataFrame, key: list[str], member: str, day: str, days: int, name: str) -> DataFrame:
    """at (key, day, ...) with `name`: how many members have a sight in the last `days` days, that day included.

    sights: (key, member, day), days as dates. Each sight of a member lasts until the day before its next one, `days` days at
    most, so a member's stays never overlap. Their beginnings and ends, summed by day, run to the number of members there, in
    two rows a sight however long the range is. Days of `at` are swept with them.
    """
    seen = sights.select(*key, member, day).distinct()
    after = F.lead(day).over(Window.partitionBy(*key, member).orderBy(day))
    ends = F.least(F.date_add(day, days), F.coalesce(after, F.date_add(day, days)))
    stays = seen.withColumn("until", ends)
    changes = stays.select(*key, F.explode(F.array(F.struct(F.col(day).alias("d"), F.lit(1).alias("c")), F.struct(F.col("until").alias("d"), F.lit(-1).alias("c")))).alias("s"))
    sums = changes.groupBy(*key, F.col("s.d").alias(day)).agg(F.sum("s.c").alias("change"))
    asked = at.select(*key, day).distinct().withColumn("asked", F.lit(True))
    both = sums.join(asked, [*key, day], "full")
    w = Window.partitionBy(*key).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    counts = both.withColumn(name, F.coalesce(F.sum("change").over(w), F.lit(0))).where("asked").select(*key, day, name)
    return at.join(counts, [*key, day], "left")
