"""Workers' activity: counts, days, work windows, tiers, weekly medians and timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visitlens.functions.columns import minutes_between, percent, ratio, sorted_list, week_from_tuesday
from visitlens.operators.ranks import counted_percentiles
from visitlens.registry import query
from visitlens.sources.views import delivery_units, visits, with_views


def flw_days(v: DataFrame) -> DataFrame:
    """One row per worker and day: visits, first and last time, distinct cases."""
    return v.groupBy("flw_id", "visit_day").agg(F.count("*").alias("n"), F.min("visit_date").alias("s"), F.max("visit_date").alias("e"), F.count_distinct("case_id").alias("cases"))


@query("aggr_work_window", with_views("""d AS (SELECT flw_id, visit_day, COUNT(*) AS n, MIN(visit_date) AS s, MAX(visit_date) AS e FROM visits GROUP BY ALL)
SELECT flw_id, COUNT(*) AS days, CAST(SUM(n) AS BIGINT) AS visits, ROUND(AVG(date_diff('microsecond', s, e) / 6e7), 4) AS avg_window_min,
 quantile_cont(n, 0.5) AS median_per_day FROM d GROUP BY flw_id"""))
def work_window(spark: SparkSession, d: str) -> DataFrame:
    return flw_days(visits(spark, d)).groupBy("flw_id").agg(
        F.count("*").alias("days"), F.sum("n").alias("visits"), F.round(F.avg(minutes_between("s", "e")), 4).alias("avg_window_min"), F.percentile("n", 0.5).alias("median_per_day")
    )


@query("aggr_work_window_busy_days", with_views("""d AS (SELECT opportunity_id, flw_id, visit_day, COUNT(*) AS n, MIN(visit_date) AS s, MAX(visit_date) AS e FROM visits GROUP BY ALL)
SELECT opportunity_id, COUNT(*) AS busy_days, ROUND(AVG(date_diff('microsecond', s, e) / 6e7), 4) AS avg_window_min FROM d WHERE n > 1 GROUP BY opportunity_id"""))
def work_window_busy_days(spark: SparkSession, d: str) -> DataFrame:
    days = visits(spark, d).groupBy("opportunity_id", "flw_id", "visit_day").agg(F.count("*").alias("n"), F.min("visit_date").alias("s"), F.max("visit_date").alias("e"))
    return days.where("n > 1").groupBy("opportunity_id").agg(F.count("*").alias("busy_days"), F.round(F.avg(minutes_between("s", "e")), 4).alias("avg_window_min"))


@query("aggr_visit_rate_capped", with_views("""d AS (SELECT flw_id, visit_day, COUNT(*) AS n, date_diff('microsecond', MIN(visit_date), MAX(visit_date)) / 6e7 AS m FROM visits GROUP BY ALL)
SELECT flw_id, ROUND(LEAST(AVG(m / n) FILTER (WHERE m >= 10), 30.0), 6) AS minutes_per_visit, COUNT(*) FILTER (WHERE m >= 10) AS rated_days FROM d GROUP BY flw_id"""))
def visit_rate(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the days' minutes per visit, days under ten minutes left out, thirty at most."""
    days = flw_days(visits(spark, d)).withColumn("m", minutes_between("s", "e"))
    return days.groupBy("flw_id").agg(
        F.round(F.when(F.count_if(F.col("m") >= 10) > 0, F.least(F.avg(F.when(F.col("m") >= 10, F.col("m") / F.col("n"))), F.lit(30.0))), 6).alias("minutes_per_visit"),
        F.count_if(F.col("m") >= 10).alias("rated_days"),
    )


@query("aggr_mean_start_time", with_views("""d AS (SELECT flw_id, visit_day, MIN(visit_date) AS s FROM visits GROUP BY ALL)
SELECT flw_id, CAST(FLOOR(AVG(extract('hour' FROM s) * 60 + extract('minute' FROM s))) AS BIGINT) AS start_minute FROM d GROUP BY flw_id"""))
def mean_start(spark: SparkSession, d: str) -> DataFrame:
    return flw_days(visits(spark, d)).groupBy("flw_id").agg(F.floor(F.avg(F.hour("s") * 60 + F.minute("s"))).alias("start_minute"))


@query("aggr_flw_basic", with_views("""d AS (SELECT flw_id, visit_day, COUNT(*) AS n, COUNT(DISTINCT case_id) AS cases FROM visits GROUP BY ALL),
c AS (SELECT flw_id, case_id, COUNT(*) AS n FROM visits GROUP BY ALL),
t AS (SELECT flw_id, COUNT(*) AS visits, ROUND(100.0 * COUNT(*) FILTER (WHERE status = 'approved') / COUNT(*), 4) AS approved_pct, MIN(visit_date) AS first_visit, MAX(visit_date) AS last_visit, COUNT(DISTINCT case_id) AS cases FROM visits GROUP BY flw_id),
x AS (SELECT flw_id, COUNT(*) AS days, quantile_cont(n, 0.5) AS median_per_day, ROUND(100.0 * COUNT(*) FILTER (WHERE cases >= 2) / COUNT(*), 4) AS days_two_cases_pct FROM d GROUP BY flw_id),
y AS (SELECT flw_id, ROUND(100.0 * COUNT(*) FILTER (WHERE n >= 2) / COUNT(*), 4) AS cases_two_visits_pct FROM c GROUP BY flw_id)
SELECT t.*, x.days, x.median_per_day, x.days_two_cases_pct, y.cases_two_visits_pct FROM t JOIN x USING (flw_id) JOIN y USING (flw_id)"""))
def flw_basic(spark: SparkSession, d: str) -> DataFrame:
    v = visits(spark, d)
    totals = v.groupBy("flw_id").agg(
        F.count("*").alias("visits"), F.round(100.0 * F.count_if(F.col("status") == "approved") / F.count("*"), 4).alias("approved_pct"),
        F.min("visit_date").alias("first_visit"), F.max("visit_date").alias("last_visit"), F.count_distinct("case_id").alias("cases"),
    )
    days = flw_days(v).groupBy("flw_id").agg(F.count("*").alias("days"), F.percentile("n", 0.5).alias("median_per_day"), F.round(100.0 * F.count_if(F.col("cases") >= 2) / F.count("*"), 4).alias("days_two_cases_pct"))
    cases = v.groupBy("flw_id", "case_id").count().groupBy("flw_id").agg(F.round(100.0 * F.count_if(F.col("count") >= 2) / F.count("*"), 4).alias("cases_two_visits_pct"))
    return totals.join(days, "flw_id").join(cases, "flw_id")


@query("aggr_flw_statistics", with_views("""f AS (SELECT flw_id, COUNT(*) AS n, date_diff('day', MIN(visit_day), MAX(visit_day)) AS tenure FROM visits GROUP BY flw_id)
SELECT COUNT(*) AS flws, ROUND(AVG(n), 6) AS mean_visits, quantile_cont(n, 0.5) AS median_visits, MIN(n) AS min_visits, MAX(n) AS max_visits, ROUND(stddev_samp(n), 6) AS std_visits,
 CAST(FLOOR(quantile_cont(n, 0.1)) AS BIGINT) AS p10, CAST(FLOOR(quantile_cont(n, 0.25)) AS BIGINT) AS p25, CAST(FLOOR(quantile_cont(n, 0.75)) AS BIGINT) AS p75, CAST(FLOOR(quantile_cont(n, 0.9)) AS BIGINT) AS p90,
 ROUND(AVG(tenure), 6) AS mean_tenure FROM f"""))
def flw_statistics(spark: SparkSession, d: str) -> DataFrame:
    f = visits(spark, d).groupBy("flw_id").agg(F.count("*").alias("n"), F.date_diff(F.max("visit_day"), F.min("visit_day")).alias("tenure"))
    p = lambda q: F.floor(F.percentile("n", q))
    return f.agg(
        F.count("*").alias("flws"), F.round(F.avg("n"), 6).alias("mean_visits"), F.percentile("n", 0.5).alias("median_visits"), F.min("n").alias("min_visits"), F.max("n").alias("max_visits"),
        F.round(F.stddev_samp("n"), 6).alias("std_visits"), p(0.1).alias("p10"), p(0.25).alias("p25"), p(0.75).alias("p75"), p(0.9).alias("p90"), F.round(F.avg("tenure"), 6).alias("mean_tenure"),
    )


@query("aggr_performance_tiers", with_views("""f AS (SELECT opportunity_id, COUNT(*) * 1.0 / COUNT(DISTINCT flw_id) AS per_flw FROM visits GROUP BY opportunity_id),
q AS (SELECT quantile_cont(per_flw, 0.25) AS lo, quantile_cont(per_flw, 0.75) AS hi FROM f)
SELECT opportunity_id, ROUND(per_flw, 6) AS per_flw, CASE WHEN per_flw >= hi THEN 'High' WHEN per_flw <= lo THEN 'Low' ELSE 'Medium' END AS tier FROM f, q"""))
def performance_tiers(spark: SparkSession, d: str) -> DataFrame:
    f = visits(spark, d).groupBy("opportunity_id").agg((F.count("*") / F.count_distinct("flw_id")).alias("per_flw"))
    q = f.agg(F.percentile("per_flw", 0.25).alias("lo"), F.percentile("per_flw", 0.75).alias("hi"))  # one row
    tier = F.when(F.col("per_flw") >= F.col("hi"), "High").when(F.col("per_flw") <= F.col("lo"), "Low").otherwise("Medium")
    return f.join(F.broadcast(q)).select("opportunity_id", F.round("per_flw", 6).alias("per_flw"), tier.alias("tier"))


@query("aggr_tiers_by_thirds", with_views("""f AS (SELECT flw_id, COUNT(*) AS n FROM visits GROUP BY flw_id), q AS (SELECT quantile_cont(n, 0.33) AS lo, quantile_cont(n, 0.67) AS hi FROM f)
SELECT flw_id, n, CASE WHEN n <= lo THEN 'Low' WHEN n >= hi THEN 'High' ELSE 'Medium' END AS tier FROM f, q"""))
def tiers_by_thirds(spark: SparkSession, d: str) -> DataFrame:
    f = visits(spark, d).groupBy("flw_id").agg(F.count("*").alias("n"))
    q = f.agg(F.percentile("n", 0.33).alias("lo"), F.percentile("n", 0.67).alias("hi"))
    return f.join(F.broadcast(q)).select("flw_id", "n", F.when(F.col("n") <= F.col("lo"), "Low").when(F.col("n") >= F.col("hi"), "High").otherwise("Medium").alias("tier"))


@query("aggr_outliers_iqr", with_views("""f AS (SELECT flw_id, COUNT(*) AS n FROM visits GROUP BY flw_id), q AS (SELECT quantile_cont(n, 0.25) AS a, quantile_cont(n, 0.75) AS b FROM f)
SELECT flw_id, n, n < a - 1.5 * (b - a) OR n > b + 1.5 * (b - a) AS is_outlier FROM f, q"""))
def outliers_iqr(spark: SparkSession, d: str) -> DataFrame:
    f = visits(spark, d).groupBy("flw_id").agg(F.count("*").alias("n"))
    q = f.agg(F.percentile("n", 0.25).alias("a"), F.percentile("n", 0.75).alias("b"))
    width = 1.5 * (F.col("b") - F.col("a"))
    return f.join(F.broadcast(q)).select("flw_id", "n", ((F.col("n") < F.col("a") - width) | (F.col("n") > F.col("b") + width)).alias("is_outlier"))


@query("aggr_outliers_sigma", with_views("""f AS (SELECT flw_id, COUNT(*) AS n FROM visits GROUP BY flw_id), q AS (SELECT AVG(n) AS m, stddev_samp(n) AS s FROM f)
SELECT flw_id, n, ROUND((n - m) / s, 6) AS z, ABS(n - m) > 2 * s AS is_outlier FROM f, q"""))
def outliers_sigma(spark: SparkSession, d: str) -> DataFrame:
    f = visits(spark, d).groupBy("flw_id").agg(F.count("*").alias("n"))
    q = f.agg(F.avg("n").alias("m"), F.stddev_samp("n").alias("s"))
    return f.join(F.broadcast(q)).select("flw_id", "n", F.round((F.col("n") - F.col("m")) / F.col("s"), 6).alias("z"), (F.abs(F.col("n") - F.col("m")) > 2 * F.col("s")).alias("is_outlier"))


@query("aggr_percentile_vector", with_views("SELECT flw_id, " + ", ".join(f"ROUND(quantile_cont(value, {p / 100}), 6) AS p{p:02d}" for p in (1, 5, 10, 20, 25, 30, 40, 50, 60, 75, 90, 95, 99)) + " FROM visits GROUP BY flw_id"))
def percentile_vector(spark: SparkSession, d: str) -> DataFrame:
    points = (1, 5, 10, 20, 25, 30, 40, 50, 60, 75, 90, 95, 99)
    got = counted_percentiles(visits(spark, d).select("flw_id", "value"), "flw_id", "value", [p / 100 for p in points], "p")
    return got.select("flw_id", *(F.round(F.col("p")[i], 6).alias(f"p{p:02d}") for i, p in enumerate(points)))


@query("aggr_recent_activity", with_views("""a AS (SELECT opportunity_id, MAX(visit_day) AS last_day FROM visits GROUP BY opportunity_id)
SELECT opportunity_id, COUNT(DISTINCT flw_id) AS flws, COUNT(DISTINCT CASE WHEN visit_day >= last_day - 6 THEN flw_id END) AS active_flws,
 ROUND(100.0 * COUNT(DISTINCT CASE WHEN visit_day >= last_day - 6 THEN flw_id END) / COUNT(DISTINCT flw_id), 4) AS active_pct FROM visits JOIN a USING (opportunity_id) GROUP BY opportunity_id"""))
def recent_activity(spark: SparkSession, d: str) -> DataFrame:
    """Workers seen in the seven days up to the opportunity's own last day."""
    v = visits(spark, d)
    last = v.groupBy("opportunity_id").agg(F.max("visit_day").alias("last_day"))
    recent = F.when(F.col("visit_day") >= F.date_sub("last_day", 6), F.col("flw_id"))
    return v.join(last, "opportunity_id").groupBy("opportunity_id").agg(
        F.count_distinct("flw_id").alias("flws"), F.count_distinct(recent).alias("active_flws"), F.round(100.0 * F.count_distinct(recent) / F.count_distinct("flw_id"), 4).alias("active_pct")
    )


@query("aggr_weekly_medians", with_views("""a AS (SELECT opportunity_id, MIN(visit_day) AS f FROM visits GROUP BY opportunity_id),
d AS (SELECT opportunity_id, flw_id, visit_day, COUNT(*) AS n, ANY_VALUE(date_diff('day', f, visit_day) // 7 + 1) AS week FROM visits JOIN a USING (opportunity_id) GROUP BY opportunity_id, flw_id, visit_day)
SELECT opportunity_id, """ + ", ".join(f"quantile_cont(n, 0.5) FILTER (WHERE week = {w}) AS week_{w}" for w in range(1, 9)) + " FROM d GROUP BY opportunity_id"))
def weekly_medians(spark: SparkSession, d: str) -> DataFrame:
    """Median visits per worker and day of the first eight weeks, each in a column."""
    v = visits(spark, d)
    first = v.groupBy("opportunity_id").agg(F.min("visit_day").alias("f"))
    days = v.join(first, "opportunity_id").groupBy("opportunity_id", "flw_id", "visit_day", "f").agg(F.count("*").alias("n"))
    week = F.floor(F.date_diff("visit_day", "f") / 7) + 1
    return days.withColumn("week", week).groupBy("opportunity_id").agg(*(F.percentile(F.when(F.col("week") == w, F.col("n")), 0.5).alias(f"week_{w}") for w in range(1, 9)))


@query("aggr_weekly_trend", with_views("""a AS (SELECT opportunity_id, MIN(visit_day) AS f FROM visits GROUP BY opportunity_id),
w AS (SELECT opportunity_id, date_diff('day', f, visit_day) // 7 + 1 AS week, COUNT(*) AS n FROM visits JOIN a USING (opportunity_id) GROUP BY ALL),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY opportunity_id ORDER BY week) AS i FROM w)
SELECT opportunity_id, ROUND(regr_slope(n, i), 6) AS slope, CASE WHEN regr_slope(n, i) > 0.1 THEN 'up' WHEN regr_slope(n, i) < -0.1 THEN 'down' ELSE 'flat' END AS trend FROM r GROUP BY opportunity_id"""))
def weekly_trend(spark: SparkSession, d: str) -> DataFrame:
    v = visits(spark, d)
    first = v.groupBy("opportunity_id").agg(F.min("visit_day").alias("f"))
    weeks = v.join(first, "opportunity_id").groupBy("opportunity_id", (F.floor(F.date_diff("visit_day", "f") / 7) + 1).alias("week")).agg(F.count("*").alias("n"))
    ranked = weeks.withColumn("i", F.row_number().over(Window.partitionBy("opportunity_id").orderBy("week")))
    slope = F.regr_slope("n", "i")
    return ranked.groupBy("opportunity_id").agg(F.round(slope, 6).alias("slope"), F.when(slope > 0.1, "up").when(slope < -0.1, "down").otherwise("flat").alias("trend"))


@query("aggr_org_summary", with_views("""m AS (SELECT MAX(visit_day) AS today FROM visits), b AS (SELECT opportunity_name, flw_id, visit_day, case_id, today FROM visits, m)
SELECT COALESCE(opportunity_name, 'ALL') AS opportunity_name, COUNT(*) AS visits, COUNT(DISTINCT case_id) AS cases, COUNT(DISTINCT flw_id) AS flws, COUNT(DISTINCT visit_day) AS days,
 date_diff('day', MIN(visit_day), MAX(visit_day)) + 1 AS active_period, date_diff('day', MAX(visit_day), MAX(today)) AS days_since,
 ROUND(COUNT(*) * 1.0 / COUNT(DISTINCT visit_day), 6) AS forms_per_day, ROUND(COUNT(*) FILTER (WHERE visit_day > today - 7) / 7.0, 6) AS visits_7d FROM b GROUP BY ROLLUP (opportunity_name)"""))
def org_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per opportunity and over all of them, by one rollup."""
    v = visits(spark, d)
    b = v.join(F.broadcast(v.agg(F.max("visit_day").alias("today"))))
    return b.rollup("opportunity_name").agg(
        F.count("*").alias("visits"), F.count_distinct("case_id").alias("cases"), F.count_distinct("flw_id").alias("flws"), F.count_distinct("visit_day").alias("days"),
        (F.date_diff(F.max("visit_day"), F.min("visit_day")) + 1).cast("bigint").alias("active_period"), F.date_diff(F.max("today"), F.max("visit_day")).cast("bigint").alias("days_since"),
        F.round(F.count("*") / F.count_distinct("visit_day"), 6).alias("forms_per_day"), F.round(F.count_if(F.col("visit_day") > F.date_sub("today", 7)) / 7.0, 6).alias("visits_7d"),
    ).withColumn("opportunity_name", F.coalesce("opportunity_name", F.lit("ALL")))


@query("aggr_opportunity_metrics", with_views("""d AS (SELECT opportunity_id, flw_id, visit_day, COUNT(*) AS n, COUNT(DISTINCT case_id) AS cases, date_diff('microsecond', MIN(visit_date), MAX(visit_date)) / 6e7 AS m FROM visits GROUP BY ALL),
l AS (SELECT opportunity_id, COUNT(*) FILTER (WHERE visit_day > z - 7) AS last7 FROM visits JOIN (SELECT opportunity_id, MAX(visit_day) AS z FROM visits GROUP BY opportunity_id) USING (opportunity_id) GROUP BY opportunity_id)
SELECT opportunity_id, COUNT(DISTINCT flw_id) AS flws, CAST(SUM(n) AS BIGINT) AS visits, COUNT(DISTINCT visit_day) AS active_days, ROUND(AVG(cases), 6) AS cases_per_flw_day, quantile_cont(n, 0.5) AS median_per_day,
 ROUND(AVG(m) FILTER (WHERE n >= 2), 6) AS window_min, ROUND(quantile_cont(m / n, 0.5) FILTER (WHERE n >= 2), 6) AS median_minutes_per_visit, ANY_VALUE(last7) * 4 AS monthly_estimate FROM d JOIN l USING (opportunity_id) GROUP BY opportunity_id"""))
def opportunity_metrics(spark: SparkSession, d: str) -> DataFrame:
    v = visits(spark, d)
    days = v.groupBy("opportunity_id", "flw_id", "visit_day").agg(F.count("*").alias("n"), F.count_distinct("case_id").alias("cases"), minutes_between(F.min("visit_date"), F.max("visit_date")).alias("m"))
    last = v.groupBy("opportunity_id").agg(F.max("visit_day").alias("z"))
    last7 = v.join(last, "opportunity_id").where(F.col("visit_day") > F.date_sub("z", 7)).groupBy("opportunity_id").agg(F.count("*").alias("last7"))
    busy = F.col("n") >= 2
    return days.join(last7, "opportunity_id").groupBy("opportunity_id").agg(
        F.count_distinct("flw_id").alias("flws"), F.sum("n").alias("visits"), F.count_distinct("visit_day").alias("active_days"), F.round(F.avg("cases"), 6).alias("cases_per_flw_day"),
        F.percentile("n", 0.5).alias("median_per_day"), F.round(F.avg(F.when(busy, F.col("m"))), 6).alias("window_min"),
        F.round(F.percentile(F.when(busy, F.col("m") / F.col("n")), 0.5), 6).alias("median_minutes_per_visit"), (F.any_value("last7") * 4).alias("monthly_estimate"),
    )


@query("aggr_average_visits_7d", with_views("""m AS (SELECT MAX(visit_day) AS today FROM visits), r AS (SELECT opportunity_id, visit_day, COUNT(*) AS n, COUNT(DISTINCT case_id) AS cases FROM visits, m WHERE visit_day > today - 7 GROUP BY ALL)
SELECT opportunity_id, ROUND(SUM(n) / 7.0, 4) AS visits_7d, ROUND(SUM(cases) / 7.0, 4) AS cases_7d FROM r GROUP BY opportunity_id"""))
def average_visits_7d(spark: SparkSession, d: str) -> DataFrame:
    v = visits(spark, d)
    recent = v.join(F.broadcast(v.agg(F.max("visit_day").alias("today")))).where(F.col("visit_day") > F.date_sub("today", 7))
    days = recent.groupBy("opportunity_id", "visit_day").agg(F.count("*").alias("n"), F.count_distinct("case_id").alias("cases"))
    return days.groupBy("opportunity_id").agg(F.round(F.sum("n") / 7.0, 4).alias("visits_7d"), F.round(F.sum("cases") / 7.0, 4).alias("cases_7d"))


@query("aggr_active_flws_7d", with_views("SELECT COUNT(DISTINCT flw_id) AS active_flws FROM visits WHERE visit_day > (SELECT MAX(visit_day) FROM visits) - 7"))
def active_flws_7d(spark: SparkSession, d: str) -> DataFrame:
    v = visits(spark, d)
    return v.join(F.broadcast(v.agg(F.max("visit_day").alias("today")))).where(F.col("visit_day") > F.date_sub("today", 7)).agg(F.count_distinct("flw_id").alias("active_flws"))


@query("aggr_service_status_counts", with_views("SELECT status, COUNT(*) AS n FROM visits WHERE status <> '' GROUP BY status"))
def service_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return visits(spark, d).where("status <> ''").groupBy("status").agg(F.count("*").alias("n"))


@query("aggr_timeline_period_totals", with_views("SELECT opportunity_id, CAST(date_trunc('month', visit_day) AS DATE) AS month, COUNT(*) AS n, MIN(visit_day) AS first_day, MAX(visit_day) AS last_day FROM visits GROUP BY ALL"))
def period_totals(spark: SparkSession, d: str) -> DataFrame:
    v = visits(spark, d).withColumn("month", F.trunc("visit_day", "month"))
    return v.groupBy("opportunity_id", "month").agg(F.count("*").alias("n"), F.min("visit_day").alias("first_day"), F.max("visit_day").alias("last_day"))


@query("aggr_monthly_pivot_totals", with_views("""SELECT COALESCE(opportunity_name, 'TOTAL') AS opportunity_name, COUNT(*) FILTER (WHERE status = 'approved') AS approved, COUNT(*) FILTER (WHERE status = 'pending') AS pending,
 COUNT(*) FILTER (WHERE status = 'rejected') AS rejected, COUNT(*) AS total FROM visits GROUP BY ROLLUP (opportunity_name)"""))
def pivot_totals(spark: SparkSession, d: str) -> DataFrame:
    """A pivot with a TOTAL row and column: the rollup adds the row."""
    v = visits(spark, d)
    wide = v.rollup("opportunity_name").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("approved", "pending", "rejected")), F.count("*").alias("total"))
    return wide.withColumn("opportunity_name", F.coalesce("opportunity_name", F.lit("TOTAL")))


@query("aggr_cube_margins", with_views("SELECT COALESCE(opportunity_name, 'TOTAL') AS opportunity_name, COALESCE(status, 'TOTAL') AS status, COUNT(*) AS n, COUNT(DISTINCT flw_id) AS flws FROM visits GROUP BY CUBE (opportunity_name, status)"))
def cube_margins(spark: SparkSession, d: str) -> DataFrame:
    c = visits(spark, d).cube("opportunity_name", "status").agg(F.count("*").alias("n"), F.count_distinct("flw_id").alias("flws"))
    return c.fillna("TOTAL", ["opportunity_name", "status"])


@query("aggr_daily_heatmap", with_views("""m AS (SELECT MIN(visit_day) AS a, MAX(visit_day) AS b FROM visits), s AS (SELECT flw_id, CAST(UNNEST(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS visit_day FROM (SELECT DISTINCT flw_id FROM visits), m)
SELECT s.flw_id, s.visit_day, COUNT(v.visit_id) AS n, ROUND(AVG(v.value), 6) AS mean_value FROM s LEFT JOIN visits v ON v.flw_id = s.flw_id AND v.visit_day = s.visit_day GROUP BY s.flw_id, s.visit_day"""))
def daily_heatmap(spark: SparkSession, d: str) -> DataFrame:
    """Worker by day over all days: counts, zero where there is none, and the day's mean value, null there."""
    v = visits(spark, d)
    span = F.broadcast(v.agg(F.min("visit_day").alias("a"), F.max("visit_day").alias("b")))
    spine = v.select("flw_id").distinct().join(span).select("flw_id", F.explode(F.sequence("a", "b")).alias("visit_day"))
    days = v.groupBy("flw_id", "visit_day").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))
    return spine.join(days, ["flw_id", "visit_day"], "left").fillna(0, ["n"])


@query("aggr_daily_matrix", with_views("SELECT flw_id, visit_day, COUNT(*) AS n FROM visits GROUP BY ALL"))
def daily_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Worker by day over all days there are, as long rows; a pair without a row is a zero."""
    return visits(spark, d).groupBy("flw_id", "visit_day").agg(F.count("*").alias("n"))


@query("aggr_flw_timeline_array", with_views("SELECT flw_id, COUNT(DISTINCT visit_day) AS days, string_agg(visit_id::VARCHAR, ',' ORDER BY visit_date, visit_id) AS visit_ids FROM visits GROUP BY flw_id"))
def flw_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Each worker's visits in order of time."""
    t = visits(spark, d).groupBy("flw_id").agg(F.count_distinct("visit_day").alias("days"), F.sort_array(F.collect_list(F.struct("visit_date", "visit_id"))).alias("t"))
    return t.select("flw_id", "days", F.array_join(F.transform("t", lambda x: x["visit_id"].cast("string")), ",").alias("visit_ids"))


@query("aggr_flw_opportunities_list", with_views("SELECT opportunity_name, COUNT(DISTINCT flw_id) AS flws, string_agg(DISTINCT status, ';' ORDER BY status) AS statuses FROM visits GROUP BY opportunity_name"))
def opportunities_list(spark: SparkSession, d: str) -> DataFrame:
    return visits(spark, d).groupBy("opportunity_name").agg(F.count_distinct("flw_id").alias("flws"), sorted_list("status").alias("statuses"))


@query("aggr_median_of_means", with_views("""a AS (SELECT visit_day, opportunity_id, COUNT(*) / 7.0 AS n FROM visits GROUP BY ALL) SELECT visit_day, ROUND(quantile_cont(n::DOUBLE, 0.5), 6) AS median_mean FROM a GROUP BY visit_day"""))
def median_of_means(spark: SparkSession, d: str) -> DataFrame:
    a = visits(spark, d).groupBy("visit_day", "opportunity_id").agg((F.count("*") / 7.0).alias("n"))
    return a.groupBy("visit_day").agg(F.round(F.percentile("n", 0.5), 6).alias("median_mean"))


@query("aggr_weeks_from_tuesday", with_views("SELECT flw_id, CAST(visit_day - ((isodow(visit_day) + 5) % 7)::INT AS DATE) AS week_start, COUNT(*) AS n FROM visits GROUP BY ALL"))
def weeks_from_tuesday(spark: SparkSession, d: str) -> DataFrame:
    return visits(spark, d).groupBy("flw_id", week_from_tuesday("visit_day").alias("week_start")).agg(F.count("*").alias("n"))


@query("aggr_gender_timeline", with_views("""w AS (SELECT flw_id, CAST(visit_day - ((isodow(visit_day) + 5) % 7)::INT AS DATE) AS week_start, COUNT(*) FILTER (WHERE gender = 'female_child') AS f, COUNT(gender) AS n FROM visits GROUP BY ALL),
p AS (SELECT COUNT(*) FILTER (WHERE gender = 'female_child') * 1.0 / COUNT(gender) AS p FROM visits)
SELECT flw_id, week_start, n, ROUND(100.0 * f / n, 4) AS female_pct, ABS((f * 1.0 / n - p) / sqrt(p * (1 - p) / n)) > 2.576 AS is_red FROM w, p WHERE n >= 5"""))
def gender_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Weekly share of girls per worker with a z-test against the population."""
    v = visits(spark, d)
    girl = F.col("gender") == "female_child"
    p = F.broadcast(v.agg((F.count_if(girl) / F.count("gender")).alias("p")))
    w = v.groupBy("flw_id", week_from_tuesday("visit_day").alias("week_start")).agg(F.count_if(girl).alias("f"), F.count("gender").alias("n")).where("n >= 5")
    z = (F.col("f") / F.col("n") - F.col("p")) / F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n"))
    return w.join(p).select("flw_id", "week_start", "n", F.round(100.0 * F.col("f") / F.col("n"), 4).alias("female_pct"), (F.abs(z) > 2.576).alias("is_red"))


@query("aggr_completion_flw", with_views("""x AS (SELECT flw_id, COUNT(*) AS assigned, COUNT(*) FILTER (WHERE status = 'completed') AS completed, string_agg(DISTINCT lpad(service_area_id::VARCHAR, 10, '0'), ';' ORDER BY lpad(service_area_id::VARCHAR, 10, '0')) AS areas, COUNT(DISTINCT CAST(checked_in_date AS DATE)) AS days FROM dus GROUP BY flw_id)
SELECT flw_id, assigned, completed, ROUND(100.0 * completed / assigned, 4) AS rate, areas, days FROM x"""))
def completion_flw(spark: SparkSession, d: str) -> DataFrame:
    x = delivery_units(spark, d).groupBy("flw_id").agg(
        F.count("*").alias("assigned"), F.count_if(F.col("status") == "completed").alias("completed"),
        sorted_list(F.lpad(F.col("service_area_id").cast("string"), 10, "0")).alias("areas"), F.count_distinct(F.col("checked_in_date").cast("date")).alias("days"),
    )
    return x.select("flw_id", "assigned", "completed", F.round(percent("completed", "assigned"), 4).alias("rate"), "areas", "days")


@query("aggr_recon_days_union", with_views("""a AS (SELECT flw_id, visit_day AS day FROM visits UNION ALL SELECT flw_id, CAST(checked_in_date AS DATE) FROM dus)
SELECT flw_id, COUNT(DISTINCT day) AS active_days, MIN(day) AS first_day, MAX(day) AS last_day FROM a GROUP BY flw_id"""))
def active_days_union(spark: SparkSession, d: str) -> DataFrame:
    """Active days from visits and from check-ins together."""
    days = visits(spark, d).select("flw_id", F.col("visit_day").alias("day")).unionByName(delivery_units(spark, d).select(F.col("flw_id").cast("bigint").alias("flw_id"), F.col("checked_in_date").cast("date").alias("day")))
    return days.groupBy("flw_id").agg(F.count_distinct("day").alias("active_days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query("aggr_opportunity_comparison", with_views("""x AS (SELECT service_area_id, COUNT(*) AS dus, COUNT(*) FILTER (WHERE status = 'completed') AS done, COUNT(DISTINCT flw_id) AS flws FROM dus GROUP BY service_area_id)
SELECT COUNT(*) AS areas, CAST(SUM(dus) AS BIGINT) AS dus, ROUND(100.0 * SUM(done) / SUM(dus), 6) AS done_pct, ROUND(AVG(100.0 * done / dus), 6) AS mean_done_pct, MAX(flws) AS most_flws FROM x"""))
def opportunity_comparison(spark: SparkSession, d: str) -> DataFrame:
    x = delivery_units(spark, d).groupBy("service_area_id").agg(F.count("*").alias("dus"), F.count_if(F.col("status") == "completed").alias("done"), F.count_distinct("flw_id").alias("flws"))
    return x.agg(F.count("*").alias("areas"), F.sum("dus").alias("dus"), F.round(100.0 * F.sum("done") / F.sum("dus"), 6).alias("done_pct"), F.round(F.avg(100.0 * F.col("done") / F.col("dus")), 6).alias("mean_done_pct"), F.max("flws").alias("most_flws"))


@query("aggr_visit_ratio_by_area", with_views("SELECT service_area_id, COUNT(*) AS dus, ROUND(COALESCE(SUM(delivery_count) * 1.0 / NULLIF(SUM(buildings), 0), 0), 6) AS deliveries_per_building FROM dus GROUP BY service_area_id"))
def deliveries_per_building(spark: SparkSession, d: str) -> DataFrame:
    g = delivery_units(spark, d).groupBy("service_area_id").agg(F.count("*").alias("dus"), F.sum("delivery_count").alias("a"), F.sum("buildings").alias("b"))
    return g.select("service_area_id", "dus", F.round(ratio("a", "b"), 6).alias("deliveries_per_building"))
