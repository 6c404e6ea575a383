"""Assessments, distributions and anomaly scores of workers' records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visitlens.functions.columns import Z99, ratio, right_closed_bin, wilson
from visitlens.functions.scores import half_open_bins, shape_tests
from visitlens.registry import query
from visitlens.sources.views import answers, visits, with_views

GIRL = "gender = 'female_child'"


@query("aggr_percent_no", with_views("SELECT flw_id, ROUND(100.0 * COUNT(*) FILTER (WHERE lower(unwell) = 'no') / NULLIF(COUNT(*) FILTER (WHERE lower(unwell) IN ('yes', 'no')), 0), 2) AS no_pct FROM visits GROUP BY flw_id"))
def percent_no(spark: SparkSession, d: str) -> DataFrame:
    no, known = F.count_if(F.lower("unwell") == "no"), F.count_if(F.lower("unwell").isin("yes", "no"))
    return visits(spark, d).groupBy("flw_id").agg(F.round(100.0 * ratio(no, known, None), 2).alias("no_pct"))


@query("aggr_gender_assessment", with_views("""f AS (SELECT flw_id, COUNT(gender) AS n, COUNT(*) FILTER (WHERE gender = 'female_child') AS g FROM visits GROUP BY flw_id), p AS (SELECT SUM(n) AS n, SUM(g) AS g FROM f), z AS (SELECT 2.5758293035489004::DOUBLE AS z),
w AS (SELECT flw_id, f.n, f.g, (f.g * 1.0 / f.n + z * z / (2 * f.n)) / (1 + z * z / f.n) AS c, z * sqrt(f.g * 1.0 / f.n * (1 - f.g * 1.0 / f.n) / f.n + z * z / (4.0 * f.n * f.n)) / (1 + z * z / f.n) AS h,
 (p.g * 1.0 / p.n + z * z / (2 * p.n)) / (1 + z * z / p.n) AS pc, z * sqrt(p.g * 1.0 / p.n * (1 - p.g * 1.0 / p.n) / p.n + z * z / (4.0 * p.n * p.n)) / (1 + z * z / p.n) AS ph FROM f, p, z)
SELECT flw_id, n, ROUND(g * 1.0 / n, 6) AS female, ROUND(c - h, 6) AS low, ROUND(c + h, 6) AS high, CASE WHEN n < 30 THEN 'insufficient' WHEN c + h < pc - ph OR c - h > pc + ph THEN 'strong_negative' ELSE 'ok' END AS result FROM w"""))
def gender_assessment(spark: SparkSession, d: str) -> DataFrame:
    """A worker's Wilson interval of the share of girls against the population's."""
    f = visits(spark, d).groupBy("flw_id").agg(F.count("gender").alias("n"), F.count_if(F.expr(GIRL)).alias("g"))
    p = F.broadcast(f.agg(F.sum("n").alias("pn"), F.sum("g").alias("pg")))
    (low, high), (p_low, p_high) = wilson(F.col("g"), F.col("n"), Z99), wilson(F.col("pg"), F.col("pn"), Z99)
    result = F.when(F.col("n") < 30, "insufficient").when((high < p_low) | (low > p_high), "strong_negative").otherwise("ok")
    return f.join(p).select("flw_id", "n", F.round(F.col("g") / F.col("n"), 6).alias("female"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), result.alias("result"))


@query("aggr_low_red_muac", with_views("""c AS (SELECT flw_id, CASE WHEN muac_cm < 9.8 THEN 'Red' WHEN muac_cm < 12.5 THEN 'Yellow' ELSE 'Green' END AS colour FROM visits)
SELECT flw_id, ROUND(100.0 * COUNT(*) FILTER (WHERE colour = 'Red') / COUNT(*), 4) AS red_pct, CASE WHEN COUNT(*) < 30 THEN 'insufficient' WHEN COUNT(*) FILTER (WHERE colour = 'Red') < 0.01 * COUNT(*) THEN 'strong_negative' ELSE 'ok' END AS result FROM c GROUP BY flw_id"""))
def low_red_muac(spark: SparkSession, d: str) -> DataFrame:
    red = F.count_if(F.col("muac_cm") < 9.8)
    return visits(spark, d).groupBy("flw_id").agg(F.round(100.0 * red / F.count("*"), 4).alias("red_pct"), F.when(F.count("*") < 30, "insufficient").when(red < 0.01 * F.count("*"), "strong_negative").otherwise("ok").alias("result"))


@query("aggr_low_young_child", with_views("SELECT flw_id, COUNT(*) FILTER (WHERE age_months < 12) AS young, CASE WHEN COUNT(*) FILTER (WHERE age_months BETWEEN 0 AND 120) = 0 THEN 'no_assessment' WHEN COUNT(*) FILTER (WHERE age_months < 12) < 0.05 * COUNT(*) THEN 'strong_negative' ELSE 'ok' END AS result FROM visits WHERE age_months BETWEEN 0 AND 120 GROUP BY flw_id"))
def low_young_child(spark: SparkSession, d: str) -> DataFrame:
    v = visits(spark, d).where(F.col("age_months").between(0, 120))
    young = F.count_if(F.col("age_months") < 12)
    return v.groupBy("flw_id").agg(young.alias("young"), F.when(F.count("*") == 0, "no_assessment").when(young < 0.05 * F.count("*"), "strong_negative").otherwise("ok").alias("result"))


MEASURES = ("visits", "muac", "age", "top_k")
_FLW_MEASURES = "f AS (SELECT flw_id, COUNT(*) AS visits, AVG(muac_cm) AS muac, AVG(age_months) AS age, MAX(k) AS top_k FROM visits GROUP BY flw_id)"


def flw_measures(v: DataFrame) -> DataFrame:
    return v.groupBy("flw_id").agg(F.count("*").alias("visits"), F.avg("muac_cm").alias("muac"), F.avg("age_months").alias("age"), F.max("k").alias("top_k"))


@query("aggr_correlation_matrix", with_views(_FLW_MEASURES + ", " + ", ".join(f"c{i}{j} AS (SELECT '{MEASURES[i]}' AS a, '{MEASURES[j]}' AS b, ROUND(corr({MEASURES[i]}, {MEASURES[j]}), 3) AS r FROM f)" for i in range(4) for j in range(i)) + " " + " UNION ALL ".join(f"SELECT * FROM c{i}{j}" for i in range(4) for j in range(i))))
def correlation_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Pearson correlations of all pairs of measures, each over the rows that have both, in one pass."""
    pairs = [(MEASURES[i], MEASURES[j]) for i in range(4) for j in range(i)]
    wide = flw_measures(visits(spark, d)).agg(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.corr(a, b), 3).alias("r")) for a, b in pairs)).alias("x"))
    return wide.select(F.inline("x"))


@query("aggr_quartile_analysis", with_views(_FLW_MEASURES + ", q AS (SELECT quantile_cont(visits, 0.25) AS a, quantile_cont(visits, 0.5) AS b, quantile_cont(visits, 0.75) AS c FROM f) SELECT CASE WHEN visits <= a THEN 1 WHEN visits <= b THEN 2 WHEN visits <= c THEN 3 ELSE 4 END AS quartile, COUNT(*) AS n, ROUND(quantile_cont(muac, 0.5), 6) AS median_muac, ROUND(quantile_cont(age, 0.5), 6) AS median_age FROM f, q GROUP BY 1"))
def quartile_analysis(spark: SparkSession, d: str) -> DataFrame:
    """Medians by quartile of visits; bins are closed on the right."""
    f = flw_measures(visits(spark, d))
    q = F.broadcast(f.agg(F.percentile("visits", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")))
    quartile = F.size(F.filter("q", lambda x: x < F.col("visits"))) + 1
    return f.join(q).groupBy(quartile.alias("quartile")).agg(F.count("*").alias("n"), F.round(F.percentile("muac", 0.5), 6).alias("median_muac"), F.round(F.percentile("age", 0.5), 6).alias("median_age"))


@query("aggr_descriptive_quantiles", with_views(_FLW_MEASURES + " SELECT i * 5 AS pct, ROUND(quantile_cont(visits::DOUBLE, i * 0.05), 6) AS visits, ROUND(quantile_cont(muac, i * 0.05), 6) AS muac FROM f, range(21) t(i) GROUP BY i".replace("quantile_cont(visits::DOUBLE, i * 0.05)", "quantile_cont(visits::DOUBLE, [" + ", ".join(str(i / 20) for i in range(21)) + "])[i + 1]").replace("quantile_cont(muac, i * 0.05)", "quantile_cont(muac, [" + ", ".join(str(i / 20) for i in range(21)) + "])[i + 1]")))
def descriptive_quantiles(spark: SparkSession, d: str) -> DataFrame:
    points = F.array(*(F.lit(i / 20) for i in range(21)))
    wide = flw_measures(visits(spark, d)).agg(F.percentile("visits", points).alias("a"), F.percentile("muac", points).alias("b"))
    rows = wide.select(F.posexplode(F.arrays_zip("a", "b")).alias("i", "x"))
    return rows.select((F.col("i") * 5).cast("bigint").alias("pct"), F.round("x.a", 6).alias("visits"), F.round("x.b", 6).alias("muac"))


@query("aggr_baseline_histogram", with_views("""SELECT 'muac_cm' AS field, CAST(GREATEST(CEIL((muac_cm - 9.5) / 1.0) - 1, 0) AS INT) AS bin, COUNT(*) AS n, ROUND(COUNT(*) * 1.0 / (SELECT COUNT(*) FROM visits), 8) AS share FROM visits GROUP BY 2
UNION ALL SELECT 'age_months', CAST(GREATEST(CEIL((age_months - 0) / 5.0) - 1, 0) AS INT), COUNT(*), ROUND(COUNT(*) * 1.0 / (SELECT COUNT(*) FROM visits), 8) FROM visits GROUP BY 2"""))
def baseline_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Right-closed bins of two fields, the first bin closed on both sides."""
    long = visits(spark, d).select(F.inline(F.array(F.struct(F.lit("muac_cm").alias("field"), right_closed_bin("muac_cm", 9.5, 1.0).alias("bin")), F.struct(F.lit("age_months").alias("field"), right_closed_bin("age_months", 0, 5.0).alias("bin")))))
    n = F.sum("n").over(Window.partitionBy("field"))
    return long.groupBy("field", "bin").agg(F.count("*").alias("n")).select("field", "bin", "n", F.round(F.col("n") / n, 8).alias("share"))


@query("aggr_categorical_baseline", with_views("SELECT 'gender' AS field, COALESCE(gender, '__BLANK__') AS category, COUNT(*) AS n FROM visits GROUP BY 2 UNION ALL SELECT 'unwell', COALESCE(NULLIF(unwell, ''), '__BLANK__'), COUNT(*) FROM visits GROUP BY 2"))
def categorical_baseline(spark: SparkSession, d: str) -> DataFrame:
    blank = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("__BLANK__"))
    long = visits(spark, d).select(F.inline(F.array(*(F.struct(F.lit(c).alias("field"), blank(c).alias("category")) for c in ("gender", "unwell")))))
    return long.groupBy("field", "category").agg(F.count("*").alias("n"))


@query("aggr_blank_shares", with_views("SELECT flw_id, ROUND(COUNT(*) FILTER (WHERE unwell IS NULL OR unwell = '') * 1.0 / COUNT(*), 6) AS unwell_blank, ROUND(COUNT(*) FILTER (WHERE gender IS NULL) * 1.0 / COUNT(*), 6) AS gender_blank, ROUND(COUNT(*) FILTER (WHERE unwell IN ('true', '1', 'yes')) * 1.0 / COUNT(*), 6) AS unwell_yes FROM visits GROUP BY flw_id"))
def blank_shares(spark: SparkSession, d: str) -> DataFrame:
    share = lambda c: F.round(F.count_if(c) / F.count("*"), 6)
    return visits(spark, d).groupBy("flw_id").agg(share(F.expr("unwell IS NULL OR unwell = ''")).alias("unwell_blank"), share(F.col("gender").isNull()).alias("gender_blank"), share(F.col("unwell").isin("true", "1", "yes")).alias("unwell_yes"))


@query("aggr_age_brackets", with_views("SELECT flw_id, " + ", ".join(f"COUNT(*) FILTER (WHERE age_months BETWEEN {a} AND {b}) AS age_{a}_{b}" for a, b in ((0, 5), (6, 11), (12, 23), (24, 35), (36, 59))) + ", ROUND(100.0 * COUNT(*) FILTER (WHERE age_months BETWEEN 0 AND 5) / COUNT(*), 4) AS infants_pct FROM visits GROUP BY flw_id"))
def age_brackets(spark: SparkSession, d: str) -> DataFrame:
    between = lambda a, b: F.count_if(F.col("age_months").between(a, b))
    return visits(spark, d).groupBy("flw_id").agg(*(between(a, b).alias(f"age_{a}_{b}") for a, b in ((0, 5), (6, 11), (12, 23), (24, 35), (36, 59))), F.round(100.0 * between(0, 5) / F.count("*"), 4).alias("infants_pct"))


@query("aggr_muac_moments", with_views("SELECT flw_id, COUNT(muac_cm) AS n, ROUND(AVG(muac_cm), 6) AS mean, ROUND(stddev_pop(muac_cm), 6) AS sd, ROUND(AVG(POW(muac_cm - m, 3)) / POW(stddev_pop(muac_cm), 3), 5) AS skew, ROUND(AVG(POW(muac_cm - m, 4)) / POW(stddev_pop(muac_cm), 4), 5) AS kurtosis FROM (SELECT *, AVG(muac_cm) OVER (PARTITION BY flw_id) AS m FROM visits) GROUP BY flw_id"))
def muac_moments(spark: SparkSession, d: str) -> DataFrame:
    """Population skewness and Pearson kurtosis (3 for a normal distribution)."""
    return visits(spark, d).groupBy("flw_id").agg(F.count("muac_cm").alias("n"), F.round(F.avg("muac_cm"), 6).alias("mean"), F.round(F.stddev_pop("muac_cm"), 6).alias("sd"), F.round(F.skewness("muac_cm"), 5).alias("skew"), F.round(F.kurtosis("muac_cm") + 3, 5).alias("kurtosis"))


@query("aggr_muac_slope", with_views("SELECT flw_id, ROUND(regr_slope(n, b), 6) AS slope FROM (SELECT flw_id, CAST(FLOOR(muac_cm - 9.5) AS INT) AS b, COUNT(*) AS n FROM visits GROUP BY ALL) GROUP BY flw_id"))
def muac_slope(spark: SparkSession, d: str) -> DataFrame:
    b = visits(spark, d).groupBy("flw_id", F.floor(F.col("muac_cm") - 9.5).alias("b")).agg(F.count("*").alias("n"))
    return b.groupBy("flw_id").agg(F.round(F.regr_slope("n", "b"), 6).alias("slope"))


@query("aggr_risk_buckets", with_views("f AS (SELECT flw_id, COUNT(*) FILTER (WHERE unwell = 'yes')::DOUBLE / COUNT(*) AS s FROM visits GROUP BY flw_id) SELECT CASE WHEN s > 0.5 THEN 'high' WHEN s > 0.2 THEN 'medium' ELSE 'low' END AS risk, COUNT(*) AS flws FROM f GROUP BY 1"))
def risk_buckets(spark: SparkSession, d: str) -> DataFrame:
    s = ratio(F.count_if(F.col("unwell") == "yes"), F.count("*"))
    f = visits(spark, d).groupBy("flw_id").agg(s.alias("s"))
    return f.groupBy(F.when(F.col("s") > 0.5, "high").when(F.col("s") > 0.2, "medium").otherwise("low").alias("risk")).agg(F.count("*").alias("flws"))


@query("aggr_field_distribution_50", with_views("""r AS (SELECT MIN(value) - 0.02 * (MAX(value) - MIN(value)) AS a, MAX(value) + 0.02 * (MAX(value) - MIN(value)) AS b FROM visits)
SELECT CAST(GREATEST(CEIL((value - a) / ((b - a) / 50)) - 1, 0) AS INT) AS bin, COUNT(*) AS n, ROUND(quantile_cont(k, 0.5), 6) AS median_k FROM visits, r GROUP BY 1"""))
def field_distribution_50(spark: SparkSession, d: str) -> DataFrame:
    """Fifty equal bins over the range widened by two per cent, right-closed, with the median of another field."""
    v = visits(spark, d)
    span = F.max("value") - F.min("value")
    r = F.broadcast(v.agg((F.min("value") - 0.02 * span).alias("a"), (F.max("value") + 0.02 * span).alias("b")))
    bin_ = F.greatest(F.ceil((F.col("value") - F.col("a")) / ((F.col("b") - F.col("a")) / 50)) - 1, F.lit(0)).cast("int")
    return v.join(r).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.round(F.percentile("k", 0.5), 6).alias("median_k"))


_FIRST_SQL = """r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY flw_id ORDER BY visit_date, visit_id) AS i FROM answers), x AS (SELECT * FROM r WHERE i <= 60),
m AS (SELECT flw_id, COUNT(*) AS visits, COUNT(*) FILTER (WHERE measured_cm BETWEEN 9.5 AND 21.5) AS valid, [""" + ", ".join(f"COUNT(*) FILTER (WHERE measured_cm >= {9.5 + i} AND measured_cm < {10.5 + i})" for i in range(12)) + """] AS bins, """ + ", ".join(f"COUNT(*) FILTER (WHERE {'age_months >= 0' if i == 0 else f'age_months > {5 * i}'} AND age_months <= {5 * i + 5}) AS age_bin_{i}" for i in range(12)) + """,
 CASE WHEN COUNT(*) >= 50 THEN ROUND(AVG(measured_cm), 6) ELSE -1 END AS cm_mean, CASE WHEN COUNT(*) >= 50 THEN ROUND(stddev_samp(measured_cm), 6) ELSE -1 END AS cm_sd, COUNT(*) FILTER (WHERE unwell = 'yes') AS unwell_n FROM x GROUP BY flw_id),
s1 AS (SELECT *, CAST(list_sum(bins) AS DOUBLE) AS total, list_max(bins) AS top, list_position(bins, list_max(bins)) AS peak, list_filter(range(1, 13), lambda i: bins[i] > 0) AS used FROM m),
s2 AS (SELECT *, list_filter(used, lambda i: i <= peak) AS u, list_filter(used, lambda i: i >= peak) AS w, list_filter(range(1, 13), lambda i: bins[i] >= 0.02 * total) AS large FROM s1),
s3 AS (SELECT *, list_transform(range(2, len(u) + 1), lambda j: bins[u[j]] - bins[u[j - 1]]) AS ups, list_transform(range(2, len(w) + 1), lambda j: bins[w[j]] - bins[w[j - 1]]) AS downs FROM s2),
ft AS (SELECT *, [len(used) >= 5, len(list_filter(ups, lambda x: x > 0)) > 0 AND len(list_filter(ups, lambda x: x < -0.02 * total)) = 0 AND len(list_filter(range(1, peak), lambda i: bins[i] >= 0.25 * top)) > 0,
 len(list_filter(downs, lambda x: x < 0)) >= 1 AND len(list_filter(downs, lambda x: x > 0.02 * total)) = 0, len(large) <= 1 OR len(list_filter(range(large[1], large[-1] + 1), lambda i: bins[i] = 0)) = 0,
 list_max(list_transform(range(1, 13), lambda i: list_max(list_transform(range(i, 13), lambda j: CASE WHEN list_min(bins[i:j]) >= 0.5 * top AND list_max(bins[i:j]) - list_min(bins[i:j]) <= 0.04 * total THEN j - i + 1 ELSE 1 END)))) < 3, top <= 0.42 * total] AS flags FROM s3)"""
SHAPES = ("five_bins", "rising", "falling", "no_gap", "no_plateau", "spread_peak")


@query("aggr_ml_features", with_views(_FIRST_SQL + " SELECT flw_id, visits, " + ", ".join(f"age_bin_{i}" for i in range(12)) + ", cm_mean, cm_sd, unwell_n, " + ", ".join(f"CASE WHEN valid >= 20 THEN flags[{i + 1}]::INT ELSE -1 END AS {name}" for i, name in enumerate(SHAPES)) + ", CASE WHEN valid >= 20 THEN list_sum(list_transform(flags, lambda f: f::INT))::INT ELSE -1 END AS shapes FROM ft"))
def ml_features(spark: SparkSession, d: str) -> DataFrame:
    """Features of the first sixty visits: ages, measurements and six tests of their shape; -1 where there are too few."""
    x = answers(spark, d).withColumn("i", F.row_number().over(Window.partitionBy("flw_id").orderBy("visit_date", "visit_id"))).where("i <= 60")
    few = lambda c: F.coalesce(F.round(F.when(F.count("*") >= 50, c), 6), F.lit(-1.0))
    b = right_closed_bin("age_months", 0, 5.0)
    m = x.groupBy("flw_id").agg(
        F.count("*").alias("visits"), F.count_if(F.col("measured_cm").between(9.5, 21.5)).alias("valid"), half_open_bins("measured_cm").alias("bins"), *(F.count_if((b == i) & F.col("age_months").between(0, 60)).alias(f"age_bin_{i}") for i in range(12)),
        few(F.avg("measured_cm")).alias("cm_mean"), few(F.stddev_samp("measured_cm")).alias("cm_sd"), F.count_if(F.col("unwell") == "yes").alias("unwell_n"),
    )
    flags = {name: F.when(F.col("valid") >= 20, t.cast("int")).otherwise(-1) for name, t in shape_tests(F.col("bins"), learnt=True).items()}
    shapes = F.when(F.col("valid") >= 20, sum((F.col(c) for c in SHAPES), F.lit(0))).otherwise(-1)
    return m.withColumns(flags).withColumn("shapes", shapes).drop("valid", "bins")


@query("aggr_real_vs_fake", with_views(_FIRST_SQL + ", k AS (SELECT flw_id % 3 = 0 AS fake, cm_mean, cm_sd, visits, " + ", ".join(f"CASE WHEN valid >= 20 THEN flags[{i + 1}]::INT END AS {name}" for i, name in enumerate(SHAPES)) + " FROM ft), a AS (SELECT " + ", ".join(f"AVG({c}) FILTER (WHERE NOT fake{x}) AS r_{c}, AVG({c}) FILTER (WHERE fake{x}) AS f_{c}" for c, x in (*((s, "") for s in SHAPES), ("visits", ""), ("cm_mean", " AND cm_mean <> -1"), ("cm_sd", " AND cm_sd <> -1"))) + " FROM k) " + " UNION ALL ".join(f"SELECT '{c}' AS feature, ROUND(r_{c}, 6) AS real_mean, ROUND(f_{c}, 6) AS fake_mean, ROUND(r_{c} - f_{c}, 6) AS delta FROM a" for c in (*SHAPES, "visits", "cm_mean", "cm_sd"))))
def real_vs_fake(spark: SparkSession, d: str) -> DataFrame:
    """Every feature's mean over real and over fake workers, -1 left out, and the difference."""
    names = (*SHAPES, "visits", "cm_mean", "cm_sd")
    long = ml_features(spark, d).select((F.col("flw_id") % 3 == 0).alias("fake"), *(F.col(c).cast("double").alias(c) for c in names)).unpivot(["fake"], list(names), "feature", "value").where("value <> -1")
    real, fake = F.avg(F.when(~F.col("fake"), F.col("value"))), F.avg(F.when(F.col("fake"), F.col("value")))
    return long.groupBy("feature").agg(F.round(real, 6).alias("real_mean"), F.round(fake, 6).alias("fake_mean"), F.round(real - fake, 6).alias("delta"))


#: Names as they are given to made-up workers, in either case.
_NAMES = "CASE WHEN flw_id % 35 = 0 THEN concat('a FAKE worker ', flw_id) WHEN flw_id % 7 IN (3, 5) THEN concat('Synthetic_', flw_id) ELSE flw_name END"


@query("aggr_synthetic_indicator", with_views(f"""n AS (SELECT opportunity_id, lower({_NAMES}) AS name FROM visits)
SELECT opportunity_id, CASE WHEN bool_or(contains(name, 'fake')) THEN '_fake' WHEN bool_or(contains(name, 'synthetic')) THEN '_synthetic' END AS indicator
FROM n GROUP BY opportunity_id"""))
def synthetic_indicator(spark: SparkSession, d: str) -> DataFrame:
    """Whether names of an opportunity's workers say that they are fake, or else synthetic, in either case."""
    has = lambda word: F.bool_or(F.lower(F.expr(_NAMES)).contains(word))
    return visits(spark, d).groupBy("opportunity_id").agg(F.when(has("fake"), "_fake").when(has("synthetic"), "_synthetic").alias("indicator"))
