"""Ordered operators: lags, frames, running totals, ranks, folds, first and last rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visitlens.functions.columns import haversine_km, minutes_between
from visitlens.operators.ranks import counted_percentiles
from visitlens.registry import query
from visitlens.sources.views import delivery_units, visits, with_views

BY_TIME = ("visit_date", "visit_id")
HAVERSINE_SQL = "2 * 6371.0 * asin(sqrt(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2)))"


def steps(v: DataFrame) -> DataFrame:
    """Each visit with the distance and the hours from the one before it on the worker's day."""
    w = Window.partitionBy("flw_id", "visit_day").orderBy(*BY_TIME)
    km = haversine_km(F.lag("latitude").over(w), F.lag("longitude").over(w), F.col("latitude"), F.col("longitude"))
    return v.withColumns({"km": km, "hours": minutes_between(F.lag("visit_date").over(w), F.col("visit_date")) / 60.0})


STEPS_SQL = f"""s AS (SELECT *, {HAVERSINE_SQL.format(a="lat0", b="latitude", c="lon0", d="longitude")} AS km, date_diff('microsecond', t0, visit_date) / 3.6e9 AS hours FROM
 (SELECT *, LAG(latitude) OVER w AS lat0, LAG(longitude) OVER w AS lon0, LAG(visit_date) OVER w AS t0 FROM visits WINDOW w AS (PARTITION BY flw_id, visit_day ORDER BY visit_date, visit_id)))"""


@query("win_lag_distance", with_views(STEPS_SQL + " SELECT visit_id, ROUND(km, 5) AS km, ROUND(hours, 6) AS hours, CASE WHEN km > 5 AND hours > 2 THEN 'Both' WHEN km > 5 THEN 'Distance' WHEN hours > 2 THEN 'Time' END AS reason FROM s"))
def lag_distance(spark: SparkSession, d: str) -> DataFrame:
    """Unusual steps within a day: over five kilometres, over two hours, or both."""
    far, late = F.col("km") > 5, F.col("hours") > 2
    return steps(visits(spark, d)).select("visit_id", F.round("km", 5).alias("km"), F.round("hours", 6).alias("hours"), F.when(far & late, "Both").when(far, "Distance").when(late, "Time").alias("reason"))


@query("win_pathway_summary", with_views(STEPS_SQL + " SELECT flw_id, COUNT(km) AS segments, ROUND(COALESCE(SUM(km), 0), 5) AS total_km, ROUND(100.0 * COUNT(*) FILTER (WHERE km > 5 OR hours > 2) / NULLIF(COUNT(km), 0), 4) AS unusual_pct FROM s GROUP BY flw_id"))
def pathway_summary(spark: SparkSession, d: str) -> DataFrame:
    return steps(visits(spark, d)).groupBy("flw_id").agg(
        F.count("km").alias("segments"), F.round(F.coalesce(F.sum("km"), F.lit(0.0)), 5).alias("total_km"), F.round(F.try_divide(100.0 * F.count_if((F.col("km") > 5) | (F.col("hours") > 2)), F.count("km")), 4).alias("unusual_pct")
    )


@query("win_consecutive_gap", with_views("""g AS (SELECT flw_id, date_diff('microsecond', visit_date, LEAD(visit_date) OVER (PARTITION BY flw_id ORDER BY visit_date, visit_id)) / 6e7 AS gap FROM visits)
SELECT flw_id, COUNT(*) AS gaps, ROUND(AVG(gap), 6) AS mean_gap FROM g WHERE gap BETWEEN 0 AND 720 GROUP BY flw_id"""))
def consecutive_gap(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("flw_id").orderBy(*BY_TIME)
    g = visits(spark, d).select("flw_id", minutes_between(F.col("visit_date"), F.lead("visit_date").over(w)).alias("gap"))
    return g.where(F.col("gap").between(0, 720)).groupBy("flw_id").agg(F.count("*").alias("gaps"), F.round(F.avg("gap"), 6).alias("mean_gap"))


@query("win_day_window_attached", with_views("""SELECT visit_id, COUNT(*) OVER w AS day_visits, CASE WHEN COUNT(*) OVER w > 1 THEN ROUND(date_diff('microsecond', MIN(visit_date) OVER w, MAX(visit_date) OVER w) / 6e7, 6) END AS day_minutes FROM visits WINDOW w AS (PARTITION BY flw_id, visit_day)"""))
def day_window_attached(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("flw_id", "visit_day")
    n = F.count("*").over(w)
    return visits(spark, d).select("visit_id", n.alias("day_visits"), F.when(n > 1, F.round(minutes_between(F.min("visit_date").over(w), F.max("visit_date").over(w)), 6)).alias("day_minutes"))


@query("win_rolling_7d", with_views("""x AS (SELECT opportunity_id, visit_day, COUNT(*) AS n, COUNT(DISTINCT case_id) AS cases FROM visits GROUP BY ALL)
SELECT opportunity_id, visit_day, ROUND(SUM(n) OVER w / 7.0, 6) AS visits_avg, ROUND(SUM(cases) OVER w / 7.0, 6) AS cases_avg FROM x WINDOW w AS (PARTITION BY opportunity_id ORDER BY visit_day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)"""))
def rolling_7d(spark: SparkSession, d: str) -> DataFrame:
    days = visits(spark, d).groupBy("opportunity_id", "visit_day").agg(F.count("*").alias("n"), F.count_distinct("case_id").alias("cases"))
    w = Window.partitionBy("opportunity_id").orderBy(F.datediff("visit_day", F.lit("1970-01-01"))).rangeBetween(-6, 0)
    return days.select("opportunity_id", "visit_day", F.round(F.sum("n").over(w) / 7.0, 6).alias("visits_avg"), F.round(F.sum("cases").over(w) / 7.0, 6).alias("cases_avg"))


@query("win_rolling_distinct", with_views("""x AS (SELECT DISTINCT flw_id, visit_day FROM visits)
SELECT x.flw_id, x.visit_day, COUNT(DISTINCT v.case_id) AS cases_7d FROM x JOIN visits v ON v.flw_id = x.flw_id AND v.visit_day BETWEEN x.visit_day - 6 AND x.visit_day GROUP BY ALL"""))
def rolling_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Distinct cases of the last seven days: each day's cases are spread over the seven days that see them."""
    v = visits(spark, d).select("flw_id", "visit_day", "case_id").distinct()
    spread = v.select("flw_id", "case_id", F.explode(F.sequence("visit_day", F.date_add("visit_day", 6))).alias("visit_day"))
    seen = spread.groupBy("flw_id", "visit_day").agg(F.count_distinct("case_id").alias("cases_7d"))
    return v.select("flw_id", "visit_day").distinct().join(seen, ["flw_id", "visit_day"])


@query("win_cumulative_daily", with_views("""m AS (SELECT MIN(visit_day) AS a, MAX(visit_day) AS b FROM visits), o AS (SELECT DISTINCT opportunity_id FROM visits),
s AS (SELECT opportunity_id, CAST(UNNEST(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM o, m), c AS (SELECT opportunity_id, visit_day AS day, COUNT(*) AS n FROM visits GROUP BY ALL)
SELECT opportunity_id, day, COALESCE(n, 0) AS n, CAST(SUM(COALESCE(n, 0)) OVER (PARTITION BY opportunity_id ORDER BY day) AS BIGINT) AS running FROM s LEFT JOIN c USING (opportunity_id, day)"""))
def cumulative_daily(spark: SparkSession, d: str) -> DataFrame:
    """Daily and running counts on a dense spine of days."""
    v = visits(spark, d)
    span = F.broadcast(v.agg(F.min("visit_day").alias("a"), F.max("visit_day").alias("b")))
    spine = v.select("opportunity_id").distinct().join(span).select("opportunity_id", F.explode(F.sequence("a", "b")).alias("day"))
    counts = v.groupBy("opportunity_id", F.col("visit_day").alias("day")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("opportunity_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return spine.join(counts, ["opportunity_id", "day"], "left").fillna(0, ["n"]).withColumn("running", F.sum("n").over(w))


@query("join_as_of_day_status", with_views("""f AS (SELECT opportunity_id, case_id, MIN(visit_day) AS day FROM visits GROUP BY ALL), x AS (SELECT opportunity_id, visit_day AS day, COUNT(*) AS n FROM visits GROUP BY ALL), y AS (SELECT opportunity_id, day, COUNT(*) AS fresh FROM f GROUP BY ALL)
SELECT opportunity_id, day, CAST(SUM(n) OVER a AS BIGINT) AS visits_so_far, CAST(SUM(COALESCE(fresh, 0)) OVER a AS BIGINT) AS cases_so_far, CAST(SUM(n) OVER b AS BIGINT) AS visits_week FROM x LEFT JOIN y USING (opportunity_id, day)
WINDOW a AS (PARTITION BY opportunity_id ORDER BY day), b AS (PARTITION BY opportunity_id ORDER BY day RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW)"""))
def as_of_day_status(spark: SparkSession, d: str) -> DataFrame:
    """Visits and distinct cases up to each day: a case counts on the day it is first seen."""
    v = visits(spark, d)
    fresh = v.groupBy("opportunity_id", "case_id").agg(F.min("visit_day").alias("day")).groupBy("opportunity_id", "day").agg(F.count("*").alias("fresh"))
    days = v.groupBy("opportunity_id", F.col("visit_day").alias("day")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("opportunity_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    week = Window.partitionBy("opportunity_id").orderBy(F.datediff("day", F.lit("1970-01-01"))).rangeBetween(-7, 0)
    j = days.join(fresh, ["opportunity_id", "day"], "left").fillna(0, ["fresh"])
    return j.select("opportunity_id", "day", F.sum("n").over(w).alias("visits_so_far"), F.sum("fresh").over(w).alias("cases_so_far"), F.sum("n").over(week).alias("visits_week"))


@query("win_timeline_by_day_number", with_views("""x AS (SELECT flw_id, date_diff('day', MIN(visit_day) OVER (PARTITION BY flw_id), visit_day) + 1 AS day FROM visits), c AS (SELECT flw_id, day, COUNT(*) AS n FROM x GROUP BY ALL),
s AS (SELECT flw_id, UNNEST(range(1, MAX(day) + 1)) AS day FROM x GROUP BY flw_id) SELECT flw_id, day, COALESCE(n, 0) AS n FROM s LEFT JOIN c USING (flw_id, day)"""))
def timeline_by_day_number(spark: SparkSession, d: str) -> DataFrame:
    """Visits on each day from a worker's first to the last, zero where there is none."""
    v = visits(spark, d).select("flw_id", "visit_day")
    span = v.groupBy("flw_id").agg(F.min("visit_day").alias("a"), F.max("visit_day").alias("b"))
    spine = span.select("flw_id", F.posexplode(F.sequence("a", "b")).alias("i", "visit_day"))
    n = v.groupBy("flw_id", "visit_day").agg(F.count("*").alias("n"))
    return spine.join(n, ["flw_id", "visit_day"], "left").select("flw_id", (F.col("i") + 1).cast("bigint").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


@query("win_timeline_30_days", with_views("""x AS (SELECT flw_id, date_diff('day', MIN(visit_day) OVER (PARTITION BY flw_id), visit_day) + 1 AS day FROM visits) SELECT flw_id, """ + ", ".join(f"COUNT(*) FILTER (WHERE day = {i}) AS day_{i}" for i in range(1, 31)) + " FROM x GROUP BY flw_id"))
def timeline_30_days(spark: SparkSession, d: str) -> DataFrame:
    """A worker's first thirty days from the first visit on, zero where there is none."""
    day = F.date_diff("visit_day", F.min("visit_day").over(Window.partitionBy("flw_id"))) + 1
    return visits(spark, d).select("flw_id", day.alias("day")).groupBy("flw_id").agg(*(F.count_if(F.col("day") == i).alias(f"day_{i}") for i in range(1, 31)))


@query("win_first_strong_negative", with_views("""b AS (SELECT flw_id, ROW_NUMBER() OVER (PARTITION BY flw_id ORDER BY visit_day) AS batch, AVG(k) > 60 AS sn FROM visits GROUP BY flw_id, visit_day),
f AS (SELECT *, MIN(CASE WHEN sn THEN batch END) OVER (PARTITION BY flw_id) AS first_sn FROM b)
SELECT flw_id, batch, CASE WHEN first_sn IS NULL THEN 'all_ok' WHEN batch < first_sn THEN 'before' WHEN batch = first_sn THEN 'first' WHEN sn THEN 'repeat' ELSE 'after' END AS label FROM f"""))
def first_strong_negative(spark: SparkSession, d: str) -> DataFrame:
    days = visits(spark, d).groupBy("flw_id", "visit_day").agg((F.avg("k") > 60).alias("sn"))
    b = days.withColumn("batch", F.row_number().over(Window.partitionBy("flw_id").orderBy("visit_day")))
    f = b.withColumn("first_sn", F.min(F.when(F.col("sn"), F.col("batch"))).over(Window.partitionBy("flw_id")))
    label = F.when(F.col("first_sn").isNull(), "all_ok").when(F.col("batch") < F.col("first_sn"), "before").when(F.col("batch") == F.col("first_sn"), "first").when(F.col("sn"), "repeat").otherwise("after")
    return f.select("flw_id", F.col("batch").cast("bigint").alias("batch"), label.alias("label"))


_RANKED = "f AS (SELECT opportunity_id, flw_id, COUNT(*) AS n FROM visits GROUP BY ALL) SELECT opportunity_id, flw_id, n, "


@query("win_ranks", with_views(_RANKED + """DENSE_RANK() OVER w AS dense, RANK() OVER w AS min_rank, ROUND(100.0 * (RANK() OVER w + (COUNT(*) OVER (PARTITION BY opportunity_id, n) - 1) / 2.0) / COUNT(*) OVER (PARTITION BY opportunity_id), 6) AS pct_rank,
 ROUND(100.0 * (RANK() OVER w - 1) / COUNT(*) OVER (PARTITION BY opportunity_id), 1) AS below_pct FROM f WINDOW w AS (PARTITION BY opportunity_id ORDER BY n)"""))
def ranks(spark: SparkSession, d: str) -> DataFrame:
    """Dense rank, lowest rank, rank as a share with ties averaged, and the share strictly below."""
    f = visits(spark, d).groupBy("opportunity_id", "flw_id").agg(F.count("*").alias("n"))
    w, every = Window.partitionBy("opportunity_id").orderBy("n"), Window.partitionBy("opportunity_id")
    ties, total = F.count("*").over(Window.partitionBy("opportunity_id", "n")), F.count("*").over(every)
    rank = F.rank().over(w)
    return f.select("opportunity_id", "flw_id", "n", F.dense_rank().over(w).cast("bigint").alias("dense"), rank.cast("bigint").alias("min_rank"), F.round(100.0 * (rank + (ties - 1) / 2.0) / total, 6).alias("pct_rank"), F.round(100.0 * (rank - 1) / total, 1).alias("below_pct"))


@query("win_threshold_percentile", with_views("""t AS (SELECT quantile_cont(value, [0.1, 0.25, 0.5, 0.75, 0.9]) AS q FROM visits) SELECT visit_id, CASE WHEN value >= q[5] THEN 90 WHEN value >= q[4] THEN 75 WHEN value >= q[3] THEN 50 WHEN value >= q[2] THEN 25 WHEN value >= q[1] THEN 10 ELSE 0 END AS pct FROM visits, t"""))
def threshold_percentile(spark: SparkSession, d: str) -> DataFrame:
    """The highest stored threshold that a value reaches."""
    v = visits(spark, d)
    t = F.broadcast(counted_percentiles(v.select(F.lit(1).alias("one"), "value"), "one", "value", [0.1, 0.25, 0.5, 0.75, 0.9], "q").select("q"))
    reached = F.size(F.filter("q", lambda x: x <= F.col("value")))
    return v.join(t).select("visit_id", F.element_at(F.array(*map(F.lit, (0, 10, 25, 50, 75, 90))), reached + 1).alias("pct"))


@query("win_latest_row", with_views("SELECT flw_id, arg_max(visit_id, row(visit_date, visit_id)) AS visit_id, arg_max(status, row(visit_date, visit_id)) AS status FROM visits GROUP BY flw_id"))
def latest_row(spark: SparkSession, d: str) -> DataFrame:
    last = F.max_by(F.struct("visit_id", "status"), F.struct(*BY_TIME))
    return visits(spark, d).groupBy("flw_id").agg(last.alias("x")).select("flw_id", "x.visit_id", "x.status")


@query("win_first_n", with_views("SELECT flw_id, visit_id, n FROM (SELECT flw_id, visit_id, ROW_NUMBER() OVER (PARTITION BY flw_id ORDER BY visit_date, visit_id) AS n FROM visits) WHERE n <= 20"))
def first_n(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("flw_id").orderBy(*BY_TIME))
    return visits(spark, d).withColumn("n", n).where("n <= 20").select("flw_id", "visit_id", F.col("n").cast("bigint").alias("n"))


def batches(v: DataFrame, most: int, least: int) -> DataFrame:
    """Whole days from the newest backwards, a new batch where a day would overflow `most`. The first batch under `least` ends
    the walk: it and all older days are dropped. The oldest batch that stays is number 1. One row per worker and batch."""
    days = v.groupBy("flw_id", "visit_day").agg(F.count("*").alias("n"))
    folded = days.groupBy("flw_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("visit_day", F.col("n").cast("bigint").alias("n"))))).alias("days"))
    fold = f"""aggregate(days, array(named_struct('size', 0L, 'from', CAST(NULL AS DATE), 'to', CAST(NULL AS DATE))),
        (a, x) -> CASE WHEN element_at(a, -1).size = 0 OR element_at(a, -1).size + x.n > {most} THEN
            concat(filter(a, b -> b.size > 0), array(named_struct('size', x.n, 'from', x.visit_day, 'to', x.visit_day)))
          ELSE concat(slice(a, 1, size(a) - 1), array(named_struct('size', element_at(a, -1).size + x.n, 'from', x.visit_day, 'to', element_at(a, -1).to))) END)"""
    kept = folded.withColumn("b", F.expr(fold)).withColumn("b", F.expr(f"slice(b, 1, IF(exists(b, x -> x.size < {least}), CAST(array_position(transform(b, x -> x.size < {least}), true) AS INT) - 1, size(b)))"))
    return kept.select("flw_id", F.posexplode(F.reverse("b")).alias("i", "x")).select("flw_id", (F.col("i") + 1).cast("bigint").alias("batch"), "x.size", F.col("x.from").alias("first_day"), F.col("x.to").alias("last_day"))


@query("win_greedy_batches", "WITH RECURSIVE " + with_views("""days AS (SELECT flw_id, visit_day, COUNT(*) AS n, ROW_NUMBER() OVER (PARTITION BY flw_id ORDER BY visit_day DESC) AS i FROM visits GROUP BY flw_id, visit_day),
r AS (SELECT flw_id, visit_day, i, n AS size, CAST(1 AS BIGINT) AS b FROM days WHERE i = 1 UNION ALL SELECT d.flw_id, d.visit_day, d.i, CASE WHEN r.size + d.n > 20 THEN d.n ELSE r.size + d.n END, CASE WHEN r.size + d.n > 20 THEN r.b + 1 ELSE r.b END FROM r JOIN days d ON d.flw_id = r.flw_id AND d.i = r.i + 1),
g AS (SELECT flw_id, b, MAX(size) AS size, MIN(visit_day) AS first_day, MAX(visit_day) AS last_day FROM r GROUP BY flw_id, b),
k AS (SELECT *, bool_and(size >= 10) OVER (PARTITION BY flw_id ORDER BY b) AS stays FROM g)
SELECT flw_id, ROW_NUMBER() OVER (PARTITION BY flw_id ORDER BY b DESC) AS batch, size, first_day, last_day FROM k WHERE stays""").removeprefix("WITH "))
def greedy_batches(spark: SparkSession, d: str) -> DataFrame:
    return batches(visits(spark, d), 20, 10)


@query("sort_top_n", with_views("SELECT flw_id, COUNT(*) AS n FROM visits GROUP BY flw_id ORDER BY n DESC, flw_id LIMIT 25"))
def top_n(spark: SparkSession, d: str) -> DataFrame:
    return visits(spark, d).groupBy("flw_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "flw_id").limit(25)


@query("sort_full_order", with_views("SELECT du_name, flw_id, buildings, ROW_NUMBER() OVER (PARTITION BY service_area_id ORDER BY buildings DESC, du_name) AS place FROM dus"))
def full_order(spark: SparkSession, d: str) -> DataFrame:
    """Order with a unique tie-break, kept as a place within the area."""
    place = F.row_number().over(Window.partitionBy("service_area_id").orderBy(F.desc("buildings"), "du_name"))
    return delivery_units(spark, d).select("du_name", "flw_id", "buildings", place.cast("bigint").alias("place"))


@query("sort_stratified_sample", with_views("SELECT opportunity_id, visit_id FROM (SELECT opportunity_id, visit_id, ROW_NUMBER() OVER (PARTITION BY opportunity_id ORDER BY (visit_id * 2654435761) % 4294967296, visit_id) AS r FROM visits WHERE k IS NOT NULL) WHERE r <= 25"))
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """Twenty-five visits per opportunity by a fixed hash: the same ones each time."""
    r = F.row_number().over(Window.partitionBy("opportunity_id").orderBy((F.col("visit_id") * 2654435761) % 4294967296, "visit_id"))
    return visits(spark, d).where("k IS NOT NULL").withColumn("r", r).where("r <= 25").select("opportunity_id", "visit_id")


@query("sort_priority_sample", with_views("SELECT flw_id, visit_id FROM (SELECT flw_id, visit_id, ROW_NUMBER() OVER (PARTITION BY flw_id ORDER BY CASE status WHEN 'rejected' THEN 0 WHEN 'pending' THEN 1 ELSE 2 END, (visit_id * 2654435761) % 4294967296) AS r FROM visits) WHERE r <= 5"))
def priority_sample(spark: SparkSession, d: str) -> DataFrame:
    priority = F.when(F.col("status") == "rejected", 0).when(F.col("status") == "pending", 1).otherwise(2)
    r = F.row_number().over(Window.partitionBy("flw_id").orderBy(priority, (F.col("visit_id") * 2654435761) % 4294967296))
    return visits(spark, d).withColumn("r", r).where("r <= 5").select("flw_id", "visit_id")


@query("sort_section_buckets", with_views("f AS (SELECT flw_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE status = 'rejected') AS bad FROM visits GROUP BY flw_id) SELECT flw_id, n, CASE WHEN bad > 12 THEN 'flagged' WHEN n >= 80 THEN 'large' WHEN n >= 60 THEN 'medium' ELSE 'small' END AS section FROM f"))
def section_buckets(spark: SparkSession, d: str) -> DataFrame:
    f = visits(spark, d).groupBy("flw_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "rejected").alias("bad"))
    section = F.when(F.col("bad") > 12, "flagged").when(F.col("n") >= 80, "large").when(F.col("n") >= 60, "medium").otherwise("small")
    return f.select("flw_id", "n", section.alias("section")).orderBy("section", F.desc("n"), "flw_id")


@query("sort_best_threshold", with_views("""x AS (SELECT k, COUNT(*) FILTER (WHERE status = 'rejected') AS p, COUNT(*) FILTER (WHERE status <> 'rejected') AS q FROM visits GROUP BY k),
c AS (SELECT k, SUM(p) OVER (ORDER BY k DESC) * 1.0 / SUM(p) OVER () AS recall, SUM(q) OVER (ORDER BY k DESC) * 1.0 / SUM(q) OVER () AS fpr FROM x)
SELECT (SELECT arg_max(k, row(recall, k)) FROM c WHERE fpr <= 0.1) AS best_recall_at_fpr10, (SELECT arg_min(k, row(fpr, k)) FROM c WHERE recall >= 0.5) AS least_fpr_at_recall50"""))
def best_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Thresholds from running counts over score values; the values are grouped first, so few rows are ordered."""
    bad = F.col("status") == "rejected"
    x = visits(spark, d).groupBy("k").agg(F.count_if(bad).alias("p"), F.count_if(~bad).alias("q"))
    w, every = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    c = x.select("k", (F.sum("p").over(w) / F.sum("p").over(every)).alias("recall"), (F.sum("q").over(w) / F.sum("q").over(every)).alias("fpr"))
    return c.agg(
        F.max_by("k", F.when(F.col("fpr") <= 0.1, F.struct("recall", "k"))).alias("best_recall_at_fpr10"),
        F.min_by("k", F.when(F.col("recall") >= 0.5, F.struct("fpr", "k"))).alias("least_fpr_at_recall50"),
    )


@query("sort_median_fold", with_views("f AS (SELECT visit_id % 10 AS fold, AVG(value) AS score FROM visits GROUP BY ALL), m AS (SELECT quantile_cont(score, 0.5) AS m FROM f) SELECT arg_min(fold, row(ROUND(ABS(score - m), 9), fold)) AS fold FROM f, m"))
def median_fold(spark: SparkSession, d: str) -> DataFrame:
    f = visits(spark, d).groupBy((F.col("visit_id") % 10).alias("fold")).agg(F.avg("value").alias("score"))
    m = F.broadcast(f.agg(F.percentile("score", 0.5).alias("m")))
    return f.join(m).agg(F.min_by("fold", F.struct(F.round(F.abs(F.col("score") - F.col("m")), 9), "fold")).alias("fold"))


@query("set_union_by_name", with_views("SELECT flw_id, visit_id, NULL AS du_name, status FROM visits UNION ALL SELECT flw_id, NULL, du_name, status FROM dus"))
def union_by_name(spark: SparkSession, d: str) -> DataFrame:
    a = visits(spark, d).select("flw_id", "visit_id", "status")
    return a.unionByName(delivery_units(spark, d).select(F.col("flw_id").cast("bigint").alias("flw_id"), "du_name", "status"), allowMissingColumns=True)


@query("set_distinct_first", with_views("SELECT case_id, arg_min(visit_id, row(visit_date, visit_id)) AS visit_id FROM visits GROUP BY case_id"))
def distinct_first(spark: SparkSession, d: str) -> DataFrame:
    """One row per case, the first in time."""
    return visits(spark, d).groupBy("case_id").agg(F.min_by("visit_id", F.struct(*BY_TIME)).alias("visit_id"))


@query("set_missing_columns", "SELECT UNNEST(['elevation_in_m', 'flagged']) AS missing_column")
def missing_columns(spark: SparkSession, d: str) -> DataFrame:
    """Required columns that a table lacks."""
    required = {"visit_id", "flw_id", "visit_date", "elevation_in_m", "flagged"}
    return spark.createDataFrame([(c,) for c in sorted(required - set(visits(spark, d).columns))], "missing_column string")


@query("set_intersect_except", with_views("(SELECT flw_id, 'both' AS side FROM (SELECT flw_id FROM visits INTERSECT SELECT flw_id FROM dus)) UNION ALL (SELECT flw_id, 'visits only' FROM (SELECT flw_id FROM visits EXCEPT SELECT flw_id FROM dus))").replace(", (SELECT", " (SELECT", 1))
def intersect_except(spark: SparkSession, d: str) -> DataFrame:
    a, b = visits(spark, d).select("flw_id"), delivery_units(spark, d).select(F.col("flw_id").cast("bigint").alias("flw_id"))
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.subtract(b).withColumn("side", F.lit("visits only")))
