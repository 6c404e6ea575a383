"""Tests of normality by workers and opportunities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visitlens.operators.ranks import counted_percentiles
from visitlens.plans.fraud import normal_cdf, normal_distance
from visitlens.registry import query
from visitlens.sources.views import answers

#: Values that a group needs, and the most that the test of ordered scores takes (fixed values).
LEAST, MOST = 300, 5000
#: The five per cent point of the Anderson-Darling distance for estimated mean and deviation (fixed value).
ANDERSON = 0.787
#: Polynomials, highest power first, in 1 / sqrt(n) for the two largest weights, in n and ln n for mean and deviation (fixed values).
_LAST, _BEFORE = (-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, 0.0), (-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0)
_SMALL_MEAN, _SMALL_SD = (-0.0006714, 0.025054, -0.39978, 0.544), (-0.0020322, 0.062767, -0.77857, 1.3822)
_MEAN, _SD = (0.0038915, -0.083751, -0.31082, -1.5861), (0.0030302, -0.082676, -0.4803)
#: Rational approximations of the normal quantile near the middle and in the tails, highest power first (fixed values).
_MID = (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608)
_MID_BELOW = (5226.495278852545925, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0)
_TAIL = (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734)
_TAIL_BELOW = (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0)
_FAR = (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772)
_FAR_BELOW = (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0)


def _poly(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(0.0)
    for c in coefficients:
        out = out * x + c
    return out


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile, to about sixteen digits."""
    q = p - 0.5
    mid = q * _poly(0.180625 - q * q, _MID) / _poly(0.180625 - q * q, _MID_BELOW)
    r = F.sqrt(-F.log(F.when(q < 0, p).otherwise(1 - p)))
    tail = F.when(r <= 5, _poly(r - 1.6, _TAIL) / _poly(r - 1.6, _TAIL_BELOW)).otherwise(_poly(r - 5, _FAR) / _poly(r - 5, _FAR_BELOW))
    return F.when(F.abs(q) <= 0.425, mid).otherwise(F.when(q < 0, -tail).otherwise(tail))


def shapiro_wilk(v: DataFrame, key: str, value: str, most: int = MOST) -> DataFrame:
    """(key, n, w, p) of the groups of 3 to `most` values: the share of a group's spread that ordered normal scores explain, and
    its approximate p-value. Larger groups are left out before any is ordered, so no task holds more than `most` values of one."""
    given = v.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("x"))
    sizes = given.groupBy(key).agg(F.count("*").alias("n"), F.avg("x").alias("mean")).where(F.col("n").between(3, most))
    r = given.join(sizes, key).withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy("x")))
    n = F.col("n").cast("double")
    m = r.withColumn("m", normal_quantile((F.col("i") - 0.375) / (n + 0.25)))
    # By symmetry the outer scores are those of the first two values; weights between them share what these leave.
    s = m.groupBy(key).agg(
        F.first("n").alias("n"), F.sum(F.col("m") * F.col("m")).alias("mm"), (-F.min(F.when(F.col("i") == 1, F.col("m")))).alias("m1"), (-F.min(F.when(F.col("i") == 2, F.col("m")))).alias("m2"),
        F.sum(F.col("m") * (F.col("x") - F.col("mean"))).alias("mx"), F.sum((F.col("x") - F.col("mean")) * (F.col("x") - F.col("mean"))).alias("ss"),
        *(F.sum(F.when(F.col("i") == at, F.col("x"))).alias(name) for name, at in (("x1", F.lit(1)), ("x2", F.lit(2)), ("y2", F.col("n") - 1), ("y1", F.col("n")))),
    )
    u = 1 / F.sqrt(n)
    a1 = F.when(F.col("n") == 3, F.lit(0.5**0.5)).otherwise(_poly(u, _LAST) + F.col("m1") / F.sqrt("mm"))
    a2 = _poly(u, _BEFORE) + F.col("m2") / F.sqrt("mm")
    few = F.col("n") <= 5
    left = F.when(few, F.col("mm") - 2 * F.col("m1") * F.col("m1")).otherwise(F.col("mm") - 2 * F.col("m1") * F.col("m1") - 2 * F.col("m2") * F.col("m2"))
    over = F.when(few, 1 - 2 * a1 * a1).otherwise(1 - 2 * a1 * a1 - 2 * a2 * a2)
    root = F.sqrt(left / over)
    outer, second = F.col("y1") - F.col("x1"), F.col("y2") - F.col("x2")
    inner = F.when(F.col("n") == 3, F.lit(0.0)).when(few, (F.col("mx") - F.col("m1") * outer) / root).otherwise((F.col("mx") - F.col("m1") * outer - F.col("m2") * second) / root)
    total = a1 * outer + F.when(few, F.lit(0.0)).otherwise(a2 * second) + inner
    w = s.where("ss > 0").select(key, "n", F.least(total * total / F.col("ss"), F.lit(1.0)).alias("w"))
    y, x = F.log(1 - F.col("w")), F.log(n)
    small = -F.log(-2.273 + 0.459 * n - y)
    z = F.when(F.col("n") <= 11, (small - _poly(n, _SMALL_MEAN)) / F.exp(_poly(n, _SMALL_SD))).otherwise((y - _poly(x, _MEAN)) / F.exp(_poly(x, _SD)))
    three = 6 / np.pi * (F.asin(F.sqrt("w")) - F.asin(F.sqrt(F.lit(0.75))))
    scored = w.select(key, "n", "w", F.when(F.col("n") == 3, three).alias("p3"), z.alias("z"))

    def tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = b["p3"].where(b["n"] == 3, normal_cdf(-b["z"].to_numpy(float)))
            yield b[[key, "n", "w"]].assign(p=p.clip(0, 1))

    return scored.mapInPandas(tails, f"{key} {v.schema[key].dataType.simpleString()}, n bigint, w double, p double")


@query("aggr_muac_shapiro")
def muac_shapiro(spark: SparkSession, d: str) -> DataFrame:
    """Measurements of workers and of opportunities: moments and median, and whether they may be normal: by ordered scores up to
    5000 values (above 0.05), by the Anderson-Darling distance beyond; groups under 300 values are not judged."""
    v = answers(spark, d)
    both = v.select(F.concat(F.lit("worker "), "flw_id").alias("of"), "measured_cm").unionByName(v.select(F.concat(F.lit("opportunity "), "opportunity_id").alias("of"), "measured_cm"))
    both = both.where("measured_cm IS NOT NULL")
    m = both.groupBy("of").agg(
        F.count("*").alias("valid_count"), F.avg("measured_cm").alias("mean"), F.stddev_samp("measured_cm").alias("std"), F.skewness("measured_cm").alias("skewness"), (F.kurtosis("measured_cm") + 3).alias("kurtosis")
    )
    enough = both.join(m.where(F.col("valid_count") >= LEAST).select("of"), "of", "left_semi")
    median = counted_percentiles(enough, "of", "measured_cm", [0.5], "q").select("of", F.col("q")[0].alias("median"))
    scores = shapiro_wilk(enough, "of", "measured_cm").select("of", "w", "p")
    large = enough.join(m.where(F.col("valid_count") > MOST).select("of"), "of", "left_semi")
    far = normal_distance(large, "of", "measured_cm").select("of", "anderson")
    limit = ANDERSON / (1 + 4 / F.col("valid_count") - 25 / (F.col("valid_count") * F.col("valid_count")))
    p = F.when(F.col("valid_count") <= MOST, F.col("p")).otherwise(F.when(F.col("anderson") < limit, 1.0).otherwise(0.01))
    j = m.join(median, "of", "left").join(scores, "of", "left").join(far, "of", "left").withColumn("pv", p)
    judged = F.when(F.col("valid_count") < LEAST, "Insufficient data").when(F.col("pv").isNull(), "Test failed").when(F.col("pv") > 0.05, "Normal").otherwise("Non-normal")
    own = lambda c, digits: F.when(F.col("valid_count") >= LEAST, F.round(c, digits)).alias(c)
    return j.select("of", "valid_count", F.round("pv", 4).alias("test_pvalue"), judged.alias("normality_result"), own("skewness", 4), own("kurtosis", 4), own("mean", 2), own("median", 2), own("std", 2), F.round("w", 6).alias("w"))
