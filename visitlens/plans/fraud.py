"""Fraud scores of workers: distribution, completion, over-reporting, age and measurement scores, and their weighted mean."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitlens.functions.columns import ladder, ratio, right_closed_bin
from visitlens.functions.scores import ALL_NO, BY_TESTS, FILLED, UNWELL_YES, authenticity, completion_anomaly, filled_pct, half_open_bins, ladder_points, shape_score, shape_tests, slope_over, tests_passed, unwell_completion_anomaly, yes_pct
from visitlens.registry import query
from visitlens.sources.views import QUESTIONS, answers, with_views

YES_NO = ("unwell", "muac_colour", *QUESTIONS)
#: The weight of each part of the composite score.
WEIGHTS = {
    "gender_sva": 12.0, "yearly_age_imbalance": 4.0, "all_no_overreporting": 8.0, "monthly_age_perfection": 1.0, "unwell_sva": 1.0, "unwell_completion": 0.1,
    "glasses_completion": 0.1, "diarrhea_completion": 0.1, "diagnosed_completion": 0.1, "muac_colour_sva": 2.0, "recent_dose_sva": 1.0, "dose_before_sva": 1.0,
    "any_vaccine_sva": 6.0, "treated_sva": 1.0, "muac_colour_completion": 0.1, "recent_dose_completion": 0.1, "dose_before_completion": 0.1, "any_vaccine_completion": 1.0,
    "diarrhea_sva": 2.0, "glasses_sva": 2.0, "diagnosed_sva": 2.0, "muac_distribution": 15.0, "treated_completion": 0.1,
}


def sva_scores(v: DataFrame, divisors: dict[str, float]) -> DataFrame:
    """(flw_id, field, sva): the summed distance between a worker's shares of answers and all workers', over the categories that
    all have, by the field's divisor, 1 at most. Blanks don't count; a worker without answers has no row."""
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), F.lit(float(d)).alias("divisor")) for f, d in divisors.items()))
    counts = v.select("flw_id", F.inline(fields)).where("value IS NOT NULL AND value <> ''").groupBy("flw_id", "field", "divisor", "value").agg(F.count("*").alias("n"))
    base = counts.groupBy("field", "value").agg(F.sum("n").alias("every"))
    base = base.join(base.groupBy("field").agg(F.sum("every").alias("total")), "field").select("field", "value", (F.col("every") / F.col("total")).alias("base"))
    own = F.col("n") / F.sum("n").over(Window.partitionBy("flw_id", "field"))
    # Categories that the worker lacks count with their share of all: one less those that the worker has.
    apart = counts.withColumn("own", own).join(base, ["field", "value"]).groupBy("flw_id", "field", "divisor").agg((1 + F.sum(F.abs(F.col("own") - F.col("base")) - F.col("base"))).alias("apart"))
    return apart.select("flw_id", "field", F.least(F.col("apart") / F.col("divisor"), F.lit(1.0)).alias("sva"))


def sva_sql(fields: dict[str, float]) -> str:
    rows = " UNION ALL ".join(f"SELECT flw_id, '{f}' AS field, {d}::DOUBLE AS divisor, {f} AS value FROM answers WHERE {f} <> ''" for f, d in fields.items())
    return f"""l AS ({rows}), b AS (SELECT field, value, COUNT(*) * 1.0 / SUM(COUNT(*)) OVER (PARTITION BY field) AS p FROM l GROUP BY field, value),
t AS (SELECT flw_id, field, divisor, COUNT(*) AS n FROM l GROUP BY ALL), c AS (SELECT flw_id, field, value, COUNT(*) AS n FROM l GROUP BY ALL),
sva AS (SELECT t.flw_id, t.field, LEAST(SUM(ABS(COALESCE(c.n, 0) * 1.0 / t.n - b.p)) / ANY_VALUE(t.divisor), 1) AS sva FROM t JOIN b ON b.field = t.field LEFT JOIN c ON c.flw_id = t.flw_id AND c.field = t.field AND c.value = b.value GROUP BY t.flw_id, t.field)"""


SVA_FIELDS = {"gender": 1.0} | dict.fromkeys(YES_NO, 2.0)


@query("aggr_sva_score", with_views(sva_sql(SVA_FIELDS) + " SELECT flw_id, field, ROUND(sva, 6) AS sva FROM sva"))
def sva_score(spark: SparkSession, d: str) -> DataFrame:
    return sva_scores(answers(spark, d), SVA_FIELDS).withColumn("sva", F.round("sva", 6))


@query("aggr_completion_anomaly", with_views("f AS (SELECT flw_id, 100.0::DOUBLE * COUNT(NULLIF(gender, '')) / COUNT(*) AS x, 100.0::DOUBLE * COUNT(NULLIF(unwell, '')) / COUNT(*) AS u FROM visits GROUP BY flw_id) SELECT flw_id, ROUND(" + ladder_points("x", FILLED) + ", 6) AS anomaly, ROUND(CASE WHEN u <= 0 OR u >= 85 THEN 0 WHEN u <= 50 THEN u / 25 ELSE (85 - u) / 35 END, 6) AS unwell_anomaly FROM f"))
def completion_anomalies(spark: SparkSession, d: str) -> DataFrame:
    """A share of answers that is neither high nor low, by two ladders."""
    f = answers(spark, d).groupBy("flw_id").agg(filled_pct("gender").alias("x"), filled_pct("unwell").alias("u"))
    return f.select("flw_id", F.round(completion_anomaly(F.col("x")), 6).alias("anomaly"), F.round(unwell_completion_anomaly(F.col("u")), 6).alias("unwell_anomaly"))


@query("aggr_overreporting", with_views("f AS (SELECT flw_id, 100.0::DOUBLE * COUNT(*) FILTER (WHERE unwell = 'yes') / NULLIF(COUNT(NULLIF(unwell, '')), 0) AS x, 100.0::DOUBLE * COUNT(*) FILTER (WHERE lower(all_no) IN ('true', '1', 'yes')) / NULLIF(COUNT(NULLIF(all_no, '')), 0) AS a FROM answers GROUP BY flw_id) SELECT flw_id, ROUND(x, 6) AS unwell_pct, ROUND(" + ladder_points("x", UNWELL_YES) + ", 6) AS unwell_score, ROUND(" + ladder_points("a", ALL_NO) + ", 6) AS all_no_score FROM f"))
def overreporting(spark: SparkSession, d: str) -> DataFrame:
    f = answers(spark, d).groupBy("flw_id").agg(yes_pct("unwell").alias("x"), yes_pct("all_no", ("true", "1", "yes")).alias("a"))
    return f.select("flw_id", F.round("x", 6).alias("unwell_pct"), F.round(ladder(F.col("x"), *UNWELL_YES), 6).alias("unwell_score"), F.round(ladder(F.col("a"), *ALL_NO), 6).alias("all_no_score"))


def age_shares(v: DataFrame, size: int, most: int = 60) -> DataFrame:
    """(flw_id, n, p): shares of the right-closed age bins below `most`, the first closed on both sides, empty ones among them."""
    k, b = most // size, right_closed_bin("age_months", 0, float(size))
    young = v.where((F.col("age_months") >= 0) & (F.col("age_months") < most)).groupBy("flw_id").agg(F.count("*").alias("n"), *(F.count_if(b == i).alias(f"c{i}") for i in range(k)))
    return young.select("flw_id", "n", F.array(*(F.col(f"c{i}") / F.col("n") for i in range(k))).alias("p"))


def _ages_sql(size: int, name: str = "p") -> str:
    k = 60 // size
    inside = lambda i: f"age_months {'>=' if i == 0 else '>'} {i * size} AND age_months <= {(i + 1) * size}"
    return f"{name} AS (SELECT flw_id, COUNT(*) AS n, [" + ", ".join(f"COUNT(*) FILTER (WHERE {inside(i)})::DOUBLE / COUNT(*)" for i in range(k)) + "] AS p FROM visits WHERE age_months >= 0 AND age_months < 60 GROUP BY flw_id)"


def _apart(k: int) -> Column:
    return F.aggregate("p", F.lit(0.0), lambda a, x: a + F.abs(x - 1.0 / k))


def _variance(k: int) -> Column:
    return (F.aggregate("p", F.lit(0.0), lambda a, x: a + x * x) - 1.0 / k) / (k - 1)


_SQUARES = "list_sum(list_transform(p, lambda x: (x - 1.0 / {k}) * (x - 1.0 / {k}))) / ({k} - 1)"
_APART = "list_sum(list_transform(p, lambda x: ABS(x - 1.0 / {k})))"


@query("aggr_age_variance_bins", with_views(_ages_sql(5) + f" SELECT flw_id, ROUND({_SQUARES.format(k=12)}, 6) AS score FROM p"))
def age_variance_bins(spark: SparkSession, d: str) -> DataFrame:
    """Sample variance of the bins' shares, which sum to one."""
    return age_shares(answers(spark, d), 5).select("flw_id", F.round(_variance(12), 6).alias("score"))


@query("aggr_age_from_uniform", with_views(_ages_sql(12) + f" SELECT flw_id, ROUND({_APART.format(k=5)}, 6) AS score FROM p"))
def age_from_uniform(spark: SparkSession, d: str) -> DataFrame:
    return age_shares(answers(spark, d), 12).select("flw_id", F.round(_apart(5), 6).alias("score"))


@query("aggr_age_yearly_imbalance", with_views(_ages_sql(12) + f" SELECT flw_id, ROUND(LEAST({_APART.format(k=5)} / 1.6, 1), 6) AS score, ROUND({_APART.format(k=5)}, 4) AS deviation, ROUND({_SQUARES.format(k=5)}, 6) AS variance FROM p"))
def age_yearly_imbalance(spark: SparkSession, d: str) -> DataFrame:
    return age_shares(answers(spark, d), 12).select("flw_id", F.round(F.least(_apart(5) / 1.6, F.lit(1.0)), 6).alias("score"), F.round(_apart(5), 4).alias("deviation"), F.round(_variance(5), 6).alias("variance"))


def monthly_perfection() -> Column:
    """Ages that are spread too evenly over sixty months; null for fewer than twenty."""
    apart = _apart(60) / (2 - 2 / 60)
    return F.when(F.col("n") >= 20, F.when(apart < 0.15, F.least((0.15 - apart) / 0.15, F.lit(1.0))).otherwise(0.0))


_PERFECT = f"CASE WHEN n >= 20 THEN CASE WHEN {_APART.format(k=60)} / (2 - 2 / 60.0) < 0.15 THEN (0.15 - {_APART.format(k=60)} / (2 - 2 / 60.0)) / 0.15 ELSE 0 END END"


@query("aggr_age_monthly_perfection", with_views(_ages_sql(1) + f" SELECT flw_id, ROUND({_PERFECT}, 6) AS score FROM p"))
def age_monthly_perfection(spark: SparkSession, d: str) -> DataFrame:
    return age_shares(answers(spark, d), 1).select("flw_id", F.round(monthly_perfection(), 6).alias("score"))


def _bins_sql(key: str, name: str = "m") -> str:
    return f"{name} AS (SELECT {key}, COUNT(*) FILTER (WHERE measured_cm BETWEEN 9.5 AND 21.5) AS valid, [" + ", ".join(f"COUNT(*) FILTER (WHERE measured_cm >= {9.5 + i} AND measured_cm < {10.5 + i})" for i in range(12)) + f"] AS bins FROM answers GROUP BY {key})"


#: Numbers of the bins, the peak and the successive steps, and then the six tests, in DuckDB's list functions.
_SHAPE = """s1 AS (SELECT *, CAST(list_sum(bins) AS DOUBLE) AS total, list_max(bins) AS top, list_position(bins, list_max(bins)) AS peak, list_filter(range(1, 13), lambda i: bins[i] > 0) AS used FROM m),
s2 AS (SELECT *, list_filter(used, lambda i: i <= peak) AS u, list_filter(used, lambda i: i >= peak) AS w, list_filter(range(1, 13), lambda i: bins[i] >= 0.02 * total) AS large FROM s1),
s3 AS (SELECT *, list_transform(range(2, len(u) + 1), lambda j: bins[u[j]] - bins[u[j - 1]]) AS ups, list_transform(range(2, len(w) + 1), lambda j: bins[w[j]] - bins[w[j - 1]]) AS downs FROM s2),
s4 AS (SELECT *, len(used) >= 5 AS five_bins, len(list_filter(ups, lambda x: x > 0)) > 0 AND len(list_filter(ups, lambda x: x < -0.02 * total)) = 0 AND len(list_filter(range(1, peak), lambda i: bins[i] >= 0.25 * top)) > 0 AS rising,
 len(downs) < 2 OR (len(list_filter(downs, lambda x: x < 0)) >= 2 AND len(list_filter(downs, lambda x: x > 0.02 * total)) = 0) AS falling,
 len(large) <= 1 OR len(list_filter(range(large[1], large[-1] + 1), lambda i: bins[i] = 0)) = 0 AS no_gap,
 len(list_filter(range(1, 11), lambda i: LEAST(bins[i], bins[i + 1], bins[i + 2]) >= GREATEST(0.02 * total, 0.2 * top) AND GREATEST(bins[i], bins[i + 1], bins[i + 2]) - LEAST(bins[i], bins[i + 1], bins[i + 2]) <= 0.03 * top)) = 0 AS no_plateau,
 top <= 0.6 * total AS spread_peak FROM s3),
shape AS (SELECT *, five_bins::INT + rising::INT + falling::INT + no_gap::INT + no_plateau::INT + spread_peak::INT AS passed FROM s4 WHERE valid >= 20 AND total > 0)"""


def measured_bins(v: DataFrame, key: str = "flw_id") -> DataFrame:
    """(key, valid, bins): measurements from 9.5 to 21.5 and their twelve bins, 21.5 itself in none."""
    return v.groupBy(key).agg(F.count_if(F.col("measured_cm").between(9.5, 21.5)).alias("valid"), half_open_bins("measured_cm").alias("bins"))


@query("aggr_muac_shape_tests", with_views(_bins_sql("flw_id") + ", " + _SHAPE + f" SELECT flw_id, valid, five_bins, rising, falling, no_gap, no_plateau, spread_peak, passed, [{', '.join(map(str, BY_TESTS))}][passed + 1]::DOUBLE AS score FROM shape"))
def muac_shape_tests(spark: SparkSession, d: str) -> DataFrame:
    """Six tests of the shape of a worker's measurements and the score of their number; workers with twenty or more."""
    m = measured_bins(answers(spark, d)).where("valid >= 20")
    bins = F.col("bins")
    return m.select("flw_id", "valid", *(t.alias(name) for name, t in shape_tests(bins).items()), tests_passed(bins).alias("passed"), shape_score(bins).alias("score")).where("passed IS NOT NULL")


@query("aggr_muac_features_passed", with_views(_bins_sql("flw_id") + ", " + _SHAPE + " SELECT passed, COUNT(*) AS flws, ROUND(COUNT(*) * 1.0 / SUM(COUNT(*)) OVER (), 6) AS share FROM shape GROUP BY passed"))
def muac_features_passed(spark: SparkSession, d: str) -> DataFrame:
    """How many workers pass how many of the six tests."""
    g = measured_bins(answers(spark, d)).where("valid >= 20").select(tests_passed(F.col("bins")).alias("passed")).groupBy("passed").agg(F.count("*").alias("flws"))
    return g.select("passed", "flws", F.round(F.col("flws") / F.sum("flws").over(Window.partitionBy()), 6).alias("share"))  # seven rows at most


def _slope_sql(at: str) -> str:
    return f"CASE WHEN len(used) >= 3 AND len({at}) >= 2 THEN list_aggregate(list_transform({at}, lambda i: (i - list_avg({at})) * bins[i]), 'sum') / list_aggregate(list_transform({at}, lambda i: (i - list_avg({at})) * (i - list_avg({at}))), 'sum') / top END"


_BAND = "CASE WHEN {x} BETWEEN 0.05 AND 0.3 THEN 2 WHEN {x} BETWEEN 0.02 AND 0.5 THEN 1 ELSE 0 END"
_AUTHENTIC = f"""a1 AS (SELECT *, {_slope_sql("u")} AS up, -({_slope_sql("w")}) AS down,
 list_max(list_transform(range(1, 13), lambda i: list_max(list_transform(range(i, 13), lambda j: CASE WHEN list_min(bins[i:j]) >= 0.5 * top AND list_max(bins[i:j]) - list_min(bins[i:j]) <= 0.04 * total THEN j - i + 1 ELSE 1 END)))) AS run FROM s4 WHERE total >= 80)
SELECT opportunity_id, ROUND(up, 6) AS up_slope, ROUND(down, 6) AS down_slope, score::DOUBLE AS score, CASE WHEN score >= 9 THEN 'highly authentic' WHEN score >= 7 THEN 'probably authentic' WHEN score >= 5 THEN 'suspicious' ELSE 'likely fabricated' END AS label FROM
 (SELECT *, CASE WHEN len(used) >= 5 THEN 2 WHEN len(used) >= 3 THEN 1 ELSE 0 END + CASE WHEN 100.0 * top / total BETWEEN 30 AND 60 THEN 2 WHEN 100.0 * top / total BETWEEN 20 AND 80 THEN 1 ELSE 0 END + {_BAND.format(x="up")} + {_BAND.format(x="down")}
  + CASE WHEN up IS NOT NULL AND len(list_filter(ups, lambda x: x < -0.02 * total)) = 0 THEN 1 ELSE 0 END + CASE WHEN down IS NOT NULL AND len(list_filter(downs, lambda x: x > 0.02 * total)) = 0 THEN 1 ELSE 0 END + CASE run WHEN 1 THEN 1 WHEN 2 THEN 0.5 ELSE 0 END AS score FROM a1)"""


@query("aggr_muac_authenticity", with_views(_bins_sql("opportunity_id") + ", " + _SHAPE + ", " + _AUTHENTIC))
def muac_authenticity(spark: SparkSession, d: str) -> DataFrame:
    """Up to eleven points for the shape of at least eighty measurements of an opportunity."""
    m = measured_bins(answers(spark, d), "opportunity_id").where(F.aggregate("bins", F.lit(0).cast("bigint"), lambda a, x: a + x) >= 80)
    parts = authenticity(F.col("bins"))
    bins, top = F.col("bins"), F.array_max("bins")
    peak = F.array_position("bins", top) - 1
    used = F.filter(F.sequence(F.lit(0), F.lit(11)), lambda i: F.get(bins, i) > 0)
    slope = lambda at: F.round(F.when((F.size(used) >= 3) & (F.size(at) >= 2), slope_over(bins, at) / top), 6)
    score = sum(parts.values(), F.lit(0.0))
    label = F.when(score >= 9, "highly authentic").when(score >= 7, "probably authentic").when(score >= 5, "suspicious").otherwise("likely fabricated")
    return m.select("opportunity_id", slope(F.filter(used, lambda i: i <= peak)).alias("up_slope"), (-slope(F.filter(used, lambda i: i >= peak))).alias("down_slope"), score.alias("score"), label.alias("label"))


def normal_distance(v: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, mean, sd, ks, anderson): distances of the values' distribution from the normal one of their mean and deviation.

    Equal values are counted first; running counts over them give both statistics exactly, and ties cost nothing.
    """
    counts = v.where(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("x")).agg(F.count("*").alias("c"))
    moments = v.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")).where("n >= 2 AND sd > 0")
    w = Window.partitionBy(key).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    j = counts.withColumn("upto", F.sum("c").over(w)).join(moments, key)

    def cdf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            z = ((b["x"] - b["mean"]) / b["sd"]).to_numpy(float)
            yield b.assign(p=normal_cdf(z), q=normal_cdf(-z))

    p = j.mapInPandas(cdf, T.StructType([*j.schema.fields, T.StructField("p", T.DoubleType()), T.StructField("q", T.DoubleType())]))
    n, c, upto = F.col("n"), F.col("c"), F.col("upto")
    gap = F.greatest(F.abs(upto / n - F.col("p")), F.abs((upto - c) / n - F.col("p")))
    # Sum over i = upto - c + 1 .. upto of (2 i - 1) ln p + (2 (n - i) + 1) ln q, all of one value.
    first = c * (2 * upto - c)
    term = first * F.log("p") + (2 * n * c - first) * F.log("q")
    return p.groupBy(key).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.first("sd").alias("sd"), F.max(gap).alias("ks"), (-F.first("n") - F.sum(term) / F.first("n")).alias("anderson"))


def normal_cdf(z: np.ndarray) -> np.ndarray:
    """The standard normal distribution, by a series near zero and a continued fraction in the tails."""
    a, out = np.abs(z), np.empty(len(z))
    near = a < 3
    x, term, total = a[near], a[near].copy(), a[near].copy()
    for k in range(1, 60):
        term = term * x * x / (2 * k + 1)
        total = total + term
    out[near] = 0.5 - total * np.exp(-x * x / 2) / np.sqrt(2 * np.pi)
    x, tail = a[~near], np.zeros((~near).sum())
    for k in range(60, 0, -1):
        tail = k / (x + tail)
    out[~near] = np.exp(-x * x / 2) / np.sqrt(2 * np.pi) / (x + tail)
    return np.where(z < 0, out, 1 - out)


def kolmogorov_p(d: Column, n: Column) -> Column:
    """Asymptotic p-value of a Kolmogorov-Smirnov distance."""
    t = (F.sqrt(n) + 0.12 + 0.11 / F.sqrt(n)) * d
    odd = sum((F.lit(2.0 * (-1) ** (k - 1)) * F.exp(-2.0 * k * k * t * t) for k in range(1, 21)), F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(t < 0.3, 1.0).otherwise(odd)))


@query("aggr_muac_normality")
def muac_normality(spark: SparkSession, d: str) -> DataFrame:
    """Measurements of an opportunity against the normal distribution: spread outside 1.05 to 1.44, Kolmogorov-Smirnov with its
    p-value (a hundred or more), Anderson-Darling against its five per cent point (three hundred or more)."""
    r = normal_distance(answers(spark, d), "opportunity_id", "measured_cm")
    miss = F.when(F.col("sd") < 1.05, 1.05 - F.col("sd")).when(F.col("sd") > 1.44, F.col("sd") - 1.44).otherwise(0.0)
    anderson = F.col("anderson") * (1 + 0.75 / F.col("n") + 2.25 / (F.col("n") * F.col("n")))
    return r.select(
        "opportunity_id", "n", F.round("sd", 3).alias("sd"), F.round(miss, 3).alias("sd_miss"), F.round("ks", 6).alias("ks"), F.round(F.when(F.col("n") >= 100, kolmogorov_p(F.col("ks"), F.col("n"))), 4).alias("ks_p"),
        F.round("anderson", 4).alias("anderson"), F.when(F.col("n") < 300, "insufficient").when(anderson < 0.752, "normal").otherwise("not normal").alias("result"),
    )


def answer_counts(v: DataFrame) -> DataFrame:
    """(flw_id, field, value, n): how often each worker gives each answer, the blank one among them; ages by month, right-closed
    below sixty, and measurements by centimetre from 9.5 to 21.5 are answers too. All parts of the score come from these."""
    age = F.when((F.col("age_months") >= 0) & (F.col("age_months") < 60), right_closed_bin("age_months", 0, 1.0).cast("string"))
    cm = F.when(F.col("measured_cm").between(9.5, 21.5), F.floor(F.col("measured_cm") - 9.5).cast("string"))
    given = {f: F.col(f) for f in SVA_FIELDS} | {"all_no": F.lower("all_no"), "age": age, "cm": cm}
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(c, F.lit("")).alias("value")) for f, c in given.items()))
    return v.select("flw_id", F.inline(pairs)).groupBy("flw_id", "field", "value").agg(F.count("*").alias("n"))


def fraud_parts(v: DataFrame) -> DataFrame:
    """One row for each worker, one column for each part of the composite score; null where a part has too little to go by.

    The answers are read and shuffled once, as counts; what follows is of a few rows for each worker.
    """
    counts = answer_counts(v)
    all_ = counts.where("value <> ''").groupBy("field", "value").agg(F.sum("n").alias("every"))
    share = all_.join(all_.groupBy("field").agg(F.sum("every").alias("total")), "field").select("field", "value", (F.col("every") / F.col("total")).alias("base"))
    entry = F.struct("value", "n", F.coalesce("base", F.lit(0.0)).alias("base"))
    by_field = counts.join(share, ["field", "value"], "left").groupBy("flw_id", "field").agg(
        F.sum("n").alias("all"), F.sum(F.when(F.col("value") != "", F.col("n"))).alias("filled"), F.collect_list(F.when(F.col("value") != "", entry)).alias("entries")
    )
    gap = lambda a, e: a + F.abs(e["n"] / F.col("filled") - e["base"]) - e["base"]
    yes = F.aggregate(F.filter("entries", lambda e: e["value"].isin("true", "1", "yes")), F.lit(0).cast("bigint"), lambda a, e: a + e["n"])
    each = by_field.select(
        "flw_id", "field", "all", "filled", F.when(F.col("filled") > 0, F.aggregate("entries", F.lit(1.0), gap)).alias("apart"), (100.0 * F.coalesce("filled", F.lit(0)) / F.col("all")).alias("filled_pct"),
        F.when(F.col("field") == "all_no", 100.0 * yes / F.col("filled")).alias("yes_pct"), F.when(F.col("field").isin("age", "cm"), F.map_from_entries(F.transform("entries", lambda e: F.struct(e["value"], e["n"])))).alias("counts"),
    )
    own = lambda f, c: F.max(F.when(F.col("field") == f, F.col(c)))
    of = lambda f: F.max_by(F.when(F.col("field") == f, F.col("counts")), F.col("field") == f)
    done = (*QUESTIONS, "unwell", "muac_colour")
    w = each.groupBy("flw_id").agg(
        own("gender", "all").alias("n_visits"), *(own(f, "apart").alias(f"a_{f}") for f in SVA_FIELDS), *(own(f, "filled_pct").alias(f"f_{f}") for f in done), own("all_no", "yes_pct").alias("yes"),
        own("age", "filled").alias("n"), own("cm", "filled").alias("valid"), of("age").alias("ages"), of("cm").alias("cms"),
    )
    array = lambda m, k: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.try_element_at(F.col(m), i.cast("string")), F.lit(0).cast("bigint")))
    w = w.select("*", array("ages", 60).alias("months"), array("cms", 12).alias("bins"))
    years = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.aggregate(F.slice("months", i * 12 + 1, 12), F.lit(0).cast("bigint"), lambda a, c: a + c))
    w = w.select("*", F.transform(years, lambda c: c / F.col("n")).alias("yearly"), F.transform("months", lambda c: c / F.col("n")).alias("p"))
    uneven = F.aggregate("yearly", F.lit(0.0), lambda a, x: a + F.abs(x - 1.0 / 5))
    return w.select(
        "flw_id", "n_visits", *(F.expr(f"CAST({ladder_points(f'f_{f}', FILLED)} AS DOUBLE)").alias(f"{f}_completion") for f in done),
        F.expr(f"CAST({ladder_points('yes', ALL_NO)} AS DOUBLE)").alias("all_no_overreporting"), *(F.least(F.col(f"a_{f}") / divisor, F.lit(1.0)).alias(f"{f}_sva") for f, divisor in SVA_FIELDS.items()), F.when(F.col("n") > 0, F.least(uneven / 1.6, F.lit(1.0))).alias("yearly_age_imbalance"),
        monthly_perfection().alias("monthly_age_perfection"), F.when(F.col("valid") >= 20, shape_score(F.col("bins"))).alias("muac_distribution"),
    )


def weighted_composite(parts: list[tuple[Column, float]]) -> Column:
    """Σ weight × score / Σ weight over the scores that aren't null."""
    top = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts), F.lit(0.0))
    return F.try_divide(top, sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts), F.lit(0.0)))


def _composite_sql() -> str:
    done = (*QUESTIONS, "unwell", "muac_colour")
    filled = ", ".join(f"100.0::DOUBLE * COUNT(NULLIF({c}, '')) / COUNT(*) AS {c}" for c in done)
    columns = {f"{c}_completion": ladder_points(f"f.{c}", FILLED) for c in done} | {f"{c}_sva": f"MAX(sva.sva) FILTER (WHERE field = '{c}')" for c in SVA_FIELDS}
    score = {name: f"({columns[name]})" if name.endswith("_completion") else f"w.{name}" for name in WEIGHTS if name.endswith(("_completion", "_sva"))}
    score |= {"all_no_overreporting": f"({ladder_points('f.a', ALL_NO)})", "yearly_age_imbalance": "y.score", "monthly_age_perfection": "mo.score", "muac_distribution": f"[{', '.join(map(str, BY_TESTS))}][sh.passed + 1]::DOUBLE"}
    top = " + ".join(f"COALESCE({score[k]} * {w}, 0)" for k, w in WEIGHTS.items())
    weight = " + ".join(f"CASE WHEN {score[k]} IS NOT NULL THEN {w} ELSE 0 END" for k, w in WEIGHTS.items())
    return f"""{sva_sql(SVA_FIELDS)}, w AS (SELECT flw_id, {', '.join(f'{v} AS {k}' for k, v in columns.items() if k.endswith('_sva'))} FROM sva GROUP BY flw_id),
f AS (SELECT flw_id, COUNT(*) AS n_visits, {filled}, 100.0::DOUBLE * COUNT(*) FILTER (WHERE lower(all_no) IN ('true', '1', 'yes')) / NULLIF(COUNT(NULLIF(all_no, '')), 0) AS a FROM answers GROUP BY flw_id),
{_ages_sql(12, 'p12')}, {_ages_sql(1, 'p1')}, y AS (SELECT flw_id, LEAST({_APART.format(k=5)} / 1.6, 1) AS score FROM p12), mo AS (SELECT flw_id, {_PERFECT} AS score FROM p1), {_bins_sql("flw_id")}, {_SHAPE},
z AS (SELECT f.flw_id, f.n_visits, ({top}) / ({weight}) AS x, {weight} AS total_weight FROM f LEFT JOIN w ON w.flw_id = f.flw_id LEFT JOIN y ON y.flw_id = f.flw_id LEFT JOIN mo ON mo.flw_id = f.flw_id LEFT JOIN shape sh ON sh.flw_id = f.flw_id)"""


@query("aggr_composite_fraud_score", with_views(_composite_sql() + " SELECT flw_id, n_visits, ROUND(x, 4) AS composite, ROUND(total_weight, 1) AS total_weight FROM z"))
def composite_fraud_score(spark: SparkSession, d: str) -> DataFrame:
    """The weighted mean of the twenty-three parts that a worker has."""
    parts = [(F.col(name), w) for name, w in WEIGHTS.items()]
    total = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    return fraud_parts(answers(spark, d)).select("flw_id", "n_visits", F.round(weighted_composite(parts), 4).alias("composite"), F.round(total, 1).alias("total_weight"))


@query("aggr_fraud_risk_labels", with_views(_composite_sql() + ", r AS (SELECT flw_id, ROUND(x, 4) AS composite, 100.0 * (RANK() OVER (ORDER BY ROUND(x, 4)) - 1) / COUNT(*) OVER () AS below FROM z) SELECT flw_id, composite, CASE WHEN composite >= 0.5 THEN 'High' WHEN composite >= 0.2 THEN 'Medium' ELSE 'Low' END AS risk, ROUND(below, 4) AS below_pct, CASE WHEN below >= 95 THEN 'top 5' WHEN below >= 90 THEN 'top 10' WHEN below >= 75 THEN 'top 25' WHEN below >= 50 THEN 'upper half' WHEN below >= 25 THEN 'lower half' ELSE 'bottom 25' END AS label FROM r"))
def fraud_risk_labels(spark: SparkSession, d: str) -> DataFrame:
    """Each worker's risk by the composite and its place among all: scores are counted before they are ranked."""
    scores = composite_fraud_score(spark, d).select("flw_id", "composite")
    steps = scores.groupBy("composite").agg(F.count("*").alias("c"))  # ten thousand and one scores at most
    upto = F.sum("c").over(Window.orderBy("composite").rowsBetween(Window.unboundedPreceding, 0))
    place = steps.select("composite", (100.0 * (upto - F.col("c")) / F.sum("c").over(Window.partitionBy())).alias("below"))
    below = F.col("below")
    label = F.when(below >= 95, "top 5").when(below >= 90, "top 10").when(below >= 75, "top 25").when(below >= 50, "upper half").when(below >= 25, "lower half").otherwise("bottom 25")
    risk = F.when(F.col("composite") >= 0.5, "High").when(F.col("composite") >= 0.2, "Medium").otherwise("Low")
    return scores.join(place, "composite").select("flw_id", "composite", risk.alias("risk"), F.round(below, 4).alias("below_pct"), label.alias("label"))
