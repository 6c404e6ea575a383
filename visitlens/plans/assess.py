"""Batches of workers' visits: assessments behind one interface, metrics in long form, patterns of findings, the weekly score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visitlens.functions.columns import Z99, haversine_km, minutes_between, ratio, wilson
from visitlens.plans.ordered import HAVERSINE_SQL, batches
from visitlens.registry import query
from visitlens.sources.views import DILIGENCE, answers, delivery_units, with_views

MOST, LEAST = 20, 10


@dataclass(frozen=True)
class Assessment:
    """What an assessment counts and when it finds fault.

    `hit` and `valid` are conditions on a visit; the indicator is the share of hits among the valid ones. `fault` gets the
    columns hits, n, all_hits and all_n (the last two over all workers) and says whether the finding is a strong negative.
    Fewer than the least number of valid visits are insufficient, none at all gets `without`.
    """

    name: str
    indicator: str
    hit: str
    valid: str
    fault: str | None = None
    share_below: float | None = None
    without: str = "insufficient_data"

    def is_fault(self) -> Column:
        if self.share_below is not None:
            return F.col("hits") < self.share_below * F.col("n")
        (low, high), (all_low, all_high) = wilson(F.col("hits"), F.col("n"), Z99), wilson(F.col("all_hits"), F.col("all_n"), Z99)
        return (F.least(high, F.lit(1.0)) < F.greatest(all_low, F.lit(0.0))) | (F.greatest(low, F.lit(0.0)) > F.least(all_high, F.lit(1.0)))


ASSESSMENTS = (
    Assessment("gender_ratio", "female_child_ratio", "gender = 'female_child'", "gender IN ('female_child', 'male_child')"),
    Assessment("low_red_muac", "red_muac_percentage", "muac_colour = 'Red'", "muac_colour IN ('Red', 'Yellow', 'Green')", share_below=0.01),
    Assessment("low_young_child", "under_12_months_percentage", "age_months < 12", "age_months BETWEEN 0 AND 120", share_below=0.05, without="no_assessment"),
)


def batched(v: DataFrame, most: int = MOST, least: int = LEAST) -> DataFrame:
    """Visits with the batch they are in, and once more under 'all' for workers with enough; days of no batch are in 'all' only."""
    b = batches(v, most, least)
    inside = v.join(b, (v["flw_id"] == b["flw_id"]) & v["visit_day"].between(b["first_day"], b["last_day"])).select(v["*"], b["batch"].cast("string").alias("batch"))
    enough = v.groupBy("flw_id").agg(F.count("*").alias("n_all")).where(F.col("n_all") >= least).select("flw_id")
    return inside.unionByName(v.join(enough, "flw_id", "left_semi").withColumn("batch", F.lit("all")))


def assessed(v: DataFrame, assessments: tuple[Assessment, ...] = ASSESSMENTS, most: int = MOST, least: int = LEAST) -> DataFrame:
    """(flw_id, opportunity_name, batch, assessment, indicator, value, n, result) of every batch, by one aggregation of all assessments."""
    counts = [f(F.expr(f"({a.valid}){extra}")).alias(f"{p}{i}") for i, a in enumerate(assessments) for p, f, extra in (("n", F.count_if, ""), ("h", F.count_if, f" AND ({a.hit})"))]
    own = batched(v, most, least).groupBy("flw_id", "opportunity_name", "batch").agg(*counts)
    every = F.broadcast(v.agg(*(c.alias(f"all_{p}{i}") for (i, a) in enumerate(assessments) for p, c in (("n", F.count_if(F.expr(a.valid))), ("h", F.count_if(F.expr(f"({a.valid}) AND ({a.hit})")))))))
    rows = F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"h{i}").alias("hits"), F.col(f"n{i}").alias("n"), F.col(f"all_h{i}").alias("all_hits"), F.col(f"all_n{i}").alias("all_n")) for i in range(len(assessments))))
    long = own.join(every).select("flw_id", "opportunity_name", "batch", F.inline(rows))
    pick = lambda values: F.get(F.array(*values), F.col("i"))
    result = F.when(F.col("n") == 0, pick([F.lit(a.without) for a in assessments])).when(F.col("n") < least, "insufficient_data").when(pick([a.is_fault() for a in assessments]), "strong_negative").otherwise(".")
    return long.select("flw_id", "opportunity_name", "batch", pick([F.lit(a.name) for a in assessments]).alias("assessment"), pick([F.lit(a.indicator) for a in assessments]).alias("indicator"), F.when(F.col("n") >= least, F.round(F.col("hits") / F.col("n"), 4)).alias("value"), "n", result.alias("result"))


def batch_sql(most: int, least: int, source: str = "answers") -> str:
    """Batches by the walk from the newest day: bt has each batch's days, x every visit with its batch and once more under 'all'."""
    return f"""days AS (SELECT flw_id, visit_day, COUNT(*) AS n, ROW_NUMBER() OVER (PARTITION BY flw_id ORDER BY visit_day DESC) AS i FROM {source} GROUP BY flw_id, visit_day),
r AS (SELECT flw_id, visit_day, i, n AS size, CAST(1 AS BIGINT) AS b FROM days WHERE i = 1 UNION ALL SELECT d.flw_id, d.visit_day, d.i, CASE WHEN r.size + d.n > {most} THEN d.n ELSE r.size + d.n END, CASE WHEN r.size + d.n > {most} THEN r.b + 1 ELSE r.b END FROM r JOIN days d ON d.flw_id = r.flw_id AND d.i = r.i + 1),
g AS (SELECT flw_id, b, MAX(size) AS size, MIN(visit_day) AS f, MAX(visit_day) AS t FROM r GROUP BY flw_id, b), k AS (SELECT *, bool_and(size >= {least}) OVER (PARTITION BY flw_id ORDER BY b) AS stays FROM g),
bt AS (SELECT flw_id, f, t, ROW_NUMBER() OVER (PARTITION BY flw_id ORDER BY b DESC) AS batch FROM k WHERE stays),
x AS (SELECT v.*, CAST(bt.batch AS VARCHAR) AS batch FROM {source} v JOIN bt ON bt.flw_id = v.flw_id AND v.visit_day BETWEEN bt.f AND bt.t UNION ALL SELECT v.*, 'all' FROM {source} v WHERE v.flw_id IN (SELECT flw_id FROM {source} GROUP BY flw_id HAVING COUNT(*) >= {least}))"""


BATCH_SQL = batch_sql(MOST, LEAST)


def _interval(h: str, n: str) -> tuple[str, str]:
    z = "2.5758293035489004"
    centre = f"({h} * 1.0 / {n} + {z} * {z} / (2 * {n})) / (1 + {z} * {z} / {n})"
    half = f"{z} * sqrt({h} * 1.0 / {n} * (1 - {h} * 1.0 / {n}) / {n} + {z} * {z} / (4.0 * {n} * {n})) / (1 + {z} * {z} / {n})"
    return f"GREATEST({centre} - {half}, 0)", f"LEAST({centre} + {half}, 1)"


(_LOW, _HIGH), (_ALL_LOW, _ALL_HIGH) = _interval("h", "n"), _interval("ah", "an")


def assess_sql(least: int, source: str = "answers") -> str:
    return f"""q AS (SELECT flw_id, opportunity_name, batch, 'gender_ratio' AS assessment, 'female_child_ratio' AS indicator, COUNT(gender) AS n, COUNT(*) FILTER (WHERE gender = 'female_child') AS h, (SELECT COUNT(gender) FROM {source}) AS an, (SELECT COUNT(*) FROM {source} WHERE gender = 'female_child') AS ah FROM x GROUP BY ALL
 UNION ALL SELECT flw_id, opportunity_name, batch, 'low_red_muac', 'red_muac_percentage', COUNT(NULLIF(muac_colour, '')), COUNT(*) FILTER (WHERE muac_colour = 'Red'), NULL, NULL FROM x GROUP BY ALL
 UNION ALL SELECT flw_id, opportunity_name, batch, 'low_young_child', 'under_12_months_percentage', COUNT(*) FILTER (WHERE age_months <= 120), COUNT(*) FILTER (WHERE age_months < 12), NULL, NULL FROM x GROUP BY ALL),
ass AS (SELECT flw_id, opportunity_name, batch, assessment, indicator, CASE WHEN n >= {least} THEN ROUND(h * 1.0 / n, 4) END AS value, n,
 CASE WHEN n = 0 AND assessment = 'low_young_child' THEN 'no_assessment' WHEN n < {least} THEN 'insufficient_data' WHEN assessment = 'gender_ratio' AND ({_HIGH} < {_ALL_LOW} OR {_LOW} > {_ALL_HIGH}) THEN 'strong_negative'
  WHEN assessment = 'low_red_muac' AND h < 0.01 * n THEN 'strong_negative' WHEN assessment = 'low_young_child' AND h < 0.05 * n THEN 'strong_negative' ELSE '.' END AS result FROM q)"""


ASSESS_SQL = assess_sql(LEAST)


def _recursive(sql: str) -> str:
    return "WITH RECURSIVE " + with_views(sql).removeprefix("WITH ")


@query("aggr_assessment_runner", _recursive(BATCH_SQL + ", " + ASSESS_SQL + " SELECT * FROM ass"))
def assessment_runner(spark: SparkSession, d: str) -> DataFrame:
    """The three assessments of every batch and of all of a worker's visits."""
    return assessed(answers(spark, d))


#: Visits of a batch at most and at least, as the rule has them, and teams of workers that have so many.
FULL, ENOUGH = 300, 100
_TEAM = {"flw_id": "flw_id % 5", "flw_name": "concat('team_', flw_id % 5)"}


@query("aggr_assessment_runner_teams", _recursive("teams AS (SELECT * REPLACE (" + ", ".join(f"{v} AS {k}" for k, v in _TEAM.items()) + ") FROM answers), " + batch_sql(FULL, ENOUGH, "teams") + ", " + assess_sql(ENOUGH, "teams") + " SELECT * FROM ass"))
def assessment_runner_teams(spark: SparkSession, d: str) -> DataFrame:
    """The same in batches of at most three hundred visits and at least a hundred, of teams of workers."""
    return assessed(answers(spark, d).withColumns({k: F.expr(v) for k, v in _TEAM.items()}), most=FULL, least=ENOUGH)


@query("aggr_assessment_latest", _recursive(BATCH_SQL + ", " + ASSESS_SQL + " SELECT flw_id, arg_max(batch, CAST(batch AS BIGINT)) AS batch, COUNT(DISTINCT batch) AS batches, COUNT(*) FILTER (WHERE result = 'strong_negative' AND last = CAST(batch AS BIGINT)) AS strong_negatives, COUNT(*) FILTER (WHERE result = 'insufficient_data' AND last = CAST(batch AS BIGINT)) AS insufficient FROM (SELECT *, MAX(CAST(batch AS BIGINT)) OVER (PARTITION BY flw_id) AS last FROM ass WHERE batch <> 'all') GROUP BY flw_id"))
def assessment_latest(spark: SparkSession, d: str) -> DataFrame:
    """A worker's report row: the findings of the latest batch."""
    n = F.col("batch").cast("bigint")
    per_batch = assessed(answers(spark, d)).where("batch <> 'all'").groupBy("flw_id", n.alias("batch")).agg(F.count_if(F.col("result") == "strong_negative").alias("s"), F.count_if(F.col("result") == "insufficient_data").alias("i"))
    return per_batch.groupBy("flw_id").agg(F.max("batch").cast("string").alias("batch"), F.count("*").alias("batches"), F.max_by("s", "batch").alias("strong_negatives"), F.max_by("i", "batch").alias("insufficient"))


METRICS = ("time_per_visit", "total_distance_traveled", "visits_per_day", "median_visits_per_day", "diligence_score", "total_visits", "work_window_hours", "percent_no_under_treatment", "deviation_no_under_treatment", "percent_no_diarrhea", "deviation_no_diarrhea")
LONG = ("flw_id", "opportunity_name", "flw_name", "batch_number", "batch_start_date", "batch_end_date", "total_visits_in_batch", "analysis_type", "metric_name", "metric_value", "assessment_result", "quality_score_name", "quality_score_value")


def percent_no(c: str) -> Column:
    return F.round(100.0 * ratio(F.count_if(F.lower(c) == "no"), F.count_if(F.lower(c).isin("yes", "no")), None), 2)


def diligence() -> Column:
    """How many of the diligence questions get more than one answer (an aggregate)."""
    return sum(((F.min(c) < F.max(c)) & F.min(c).isNotNull()).cast("int") for c in DILIGENCE[1:]) + ((F.min(DILIGENCE[0]) < F.max(DILIGENCE[0])) & F.min(DILIGENCE[0]).isNotNull()).cast("int")


@query("aggr_diligence_score", with_views("SELECT flw_id, " + " + ".join(f"(COUNT(DISTINCT {c}) > 1)::INT" for c in DILIGENCE) + " AS diligence FROM answers GROUP BY flw_id"))
def diligence_score(spark: SparkSession, d: str) -> DataFrame:
    return answers(spark, d).groupBy("flw_id").agg(F.coalesce(diligence(), F.lit(0)).alias("diligence"))


def batch_metrics(v: DataFrame) -> DataFrame:
    """One row for each batch: days, ways, windows of work, diligence, and shares of no against all workers'."""
    keys = ["flw_id", "opportunity_name", "batch"]
    day, way = Window.partitionBy("flw_id", "visit_day"), Window.partitionBy(*keys).orderBy("visit_date", "visit_id")
    window = v.withColumns({"day_n": F.count("*").over(day), "day_minutes": minutes_between(F.min("visit_date").over(day), F.max("visit_date").over(day))})
    km = haversine_km(F.lag("latitude").over(way), F.lag("longitude").over(way), F.col("latitude"), F.col("longitude"))
    x = batched(window).withColumns({"km": km, "first_of_day": (F.row_number().over(Window.partitionBy(*keys, "visit_day").orderBy("visit_date", "visit_id")) == 1)})
    many = F.col("day_n") > 1
    every = F.broadcast(v.agg(percent_no("treated").alias("all_treated"), percent_no("diarrhea").alias("all_diarrhea")))
    days = F.count_if("first_of_day")
    g = x.groupBy(*keys).agg(
        F.max("flw_name").alias("flw_name"), F.min("visit_day").alias("batch_start_date"), F.max("visit_day").alias("batch_end_date"), F.count("*").alias("total_visits_in_batch"),
        F.round(F.avg(F.when(many, F.col("day_minutes") / F.col("day_n"))), 2).alias("time_per_visit"), F.round(F.when(F.count("*") >= 2, F.sum("km")), 3).alias("total_distance_traveled"),
        F.round(F.count("*") / days, 2).alias("visits_per_day"), F.round(F.percentile(F.when(F.col("first_of_day"), F.col("day_n")), 0.5), 1).alias("median_visits_per_day"),
        F.coalesce(diligence(), F.lit(0)).cast("double").alias("diligence_score"), F.count("*").cast("double").alias("total_visits"), F.round(F.avg(F.when(many, F.col("day_minutes"))) / 60, 2).alias("work_window_hours"),
        percent_no("treated").alias("percent_no_under_treatment"), percent_no("diarrhea").alias("percent_no_diarrhea"),
    )
    return g.join(every).withColumns({"deviation_no_under_treatment": F.round(F.col("percent_no_under_treatment") - F.col("all_treated"), 2), "deviation_no_diarrhea": F.round(F.col("percent_no_diarrhea") - F.col("all_diarrhea"), 2)})


_NO = "ROUND(100.0 * COUNT(*) FILTER (WHERE {c} = 'no') / NULLIF(COUNT(*) FILTER (WHERE {c} IN ('yes', 'no')), 0), 2)"
_METRICS_SQL = f"""dw AS (SELECT flw_id, visit_day, COUNT(*) AS day_n, date_diff('microsecond', MIN(visit_date), MAX(visit_date)) / 6e7 AS day_minutes FROM answers GROUP BY flw_id, visit_day),
st AS (SELECT *, LAG(latitude) OVER w AS lat0, LAG(longitude) OVER w AS lon0 FROM x WINDOW w AS (PARTITION BY flw_id, batch ORDER BY visit_date, visit_id)),
md AS (SELECT x.flw_id, x.batch, quantile_cont(day_n, 0.5) AS median FROM (SELECT DISTINCT flw_id, batch, visit_day FROM x) x JOIN dw USING (flw_id, visit_day) GROUP BY ALL),
mt AS (SELECT st.flw_id, opportunity_name, st.batch, MAX(flw_name) AS flw_name, MIN(st.visit_day) AS f, MAX(st.visit_day) AS t, COUNT(*) AS n,
 [ROUND(AVG(day_minutes / day_n) FILTER (WHERE day_n > 1), 2), CASE WHEN COUNT(*) > 1 THEN ROUND(SUM({HAVERSINE_SQL.format(a="lat0", b="latitude", c="lon0", d="longitude")}), 3) END, ROUND(COUNT(*) * 1.0 / COUNT(DISTINCT st.visit_day), 2), ROUND(ANY_VALUE(median), 1),
  {" + ".join(f"(COUNT(DISTINCT {c}) > 1)::INT" for c in DILIGENCE)}, COUNT(*), ROUND(AVG(day_minutes) FILTER (WHERE day_n > 1) / 60, 2),
  {_NO.format(c="treated")}, ROUND({_NO.format(c="treated")} - (SELECT {_NO.format(c="treated")} FROM answers), 2), {_NO.format(c="diarrhea")}, ROUND({_NO.format(c="diarrhea")} - (SELECT {_NO.format(c="diarrhea")} FROM answers), 2)] AS metrics
 FROM st JOIN dw ON dw.flw_id = st.flw_id AND dw.visit_day = st.visit_day JOIN md ON md.flw_id = st.flw_id AND md.batch = st.batch GROUP BY st.flw_id, opportunity_name, st.batch)"""


@query("aggr_batch_metrics_long", _recursive(BATCH_SQL + ", " + ASSESS_SQL + ", " + _METRICS_SQL + f""" SELECT flw_id, opportunity_name, flw_name, batch AS batch_number, f AS batch_start_date, t AS batch_end_date, n AS total_visits_in_batch, 'flw_metrics' AS analysis_type, UNNEST({list(METRICS)}) AS metric_name, UNNEST(metrics)::DOUBLE AS metric_value, NULL AS assessment_result, NULL AS quality_score_name, NULL::DOUBLE AS quality_score_value FROM mt
UNION ALL SELECT flw_id, mt.opportunity_name, flw_name, batch, f, t, mt.n, 'quality_assessment', indicator, value, result, NULL, NULL FROM ass JOIN mt USING (flw_id, batch)"""))
def batch_metrics_long(spark: SparkSession, d: str) -> DataFrame:
    """Metrics and assessments of each batch in thirteen columns, one row for each metric."""
    v = answers(spark, d)
    head = ["flw_id", "opportunity_name", "flw_name", "batch", "batch_start_date", "batch_end_date", "total_visits_in_batch"]
    wide = batch_metrics(v)
    metrics = wide.unpivot(head, list(METRICS), "metric_name", "metric_value").withColumns({"analysis_type": F.lit("flw_metrics"), "assessment_result": F.lit(None).cast("string")})
    found = assessed(v).select("flw_id", "batch", F.col("indicator").alias("metric_name"), F.col("value").alias("metric_value"), F.col("result").alias("assessment_result"))
    quality = wide.select(*head).join(found, ["flw_id", "batch"]).withColumn("analysis_type", F.lit("quality_assessment"))
    long = metrics.unionByName(quality).withColumnRenamed("batch", "batch_number")
    return long.withColumns({"quality_score_name": F.lit(None).cast("string"), "quality_score_value": F.lit(None).cast("double")}).select(*LONG)


@query("aggr_strong_negative_patterns", _recursive(BATCH_SQL + ", " + ASSESS_SQL + """, nb AS (SELECT *, CAST(batch AS BIGINT) AS k, result = 'strong_negative' AS sn FROM ass WHERE batch <> 'all'), fs AS (SELECT *, MIN(CASE WHEN sn THEN k END) OVER (PARTITION BY flw_id, assessment) AS first FROM nb),
lb AS (SELECT *, CASE WHEN first IS NULL THEN 'all_ok' WHEN k < first THEN 'before' WHEN k = first THEN 'first' WHEN sn THEN 'repeat' ELSE 'after' END AS label FROM fs)
SELECT assessment, COALESCE(opportunity_name, 'All Opportunities') AS opportunity, COUNT(DISTINCT flw_id) AS flws, COUNT(*) AS batches, """ + ", ".join(f"ROUND(100.0 * COUNT(*) FILTER (WHERE label = '{x}') / COUNT(*), 1) AS pct_{x}" for x in ("all_ok", "before", "first", "repeat", "after")) + """,
 ROUND(100.0 * COUNT(*) FILTER (WHERE label = 'repeat') / NULLIF(COUNT(*) FILTER (WHERE label IN ('repeat', 'after')), 0), 1) AS pct_repeat_of_later FROM lb GROUP BY GROUPING SETS ((assessment, opportunity_name), (assessment))"""))
def strong_negative_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Where each batch stands to its worker's first strong negative, in per cent by opportunity and over all of them."""
    b = assessed(answers(spark, d)).where("batch <> 'all'").select("flw_id", "opportunity_name", "assessment", F.col("batch").cast("bigint").alias("k"), (F.col("result") == "strong_negative").alias("sn"))
    first = F.min(F.when(F.col("sn"), F.col("k"))).over(Window.partitionBy("flw_id", "assessment"))
    f = b.withColumn("first", first)
    label = F.when(F.col("first").isNull(), "all_ok").when(F.col("k") < F.col("first"), "before").when(F.col("k") == F.col("first"), "first").when(F.col("sn"), "repeat").otherwise("after")
    is_ = lambda x: F.count_if(F.col("label") == x)
    g = f.withColumn("label", label).groupingSets([["assessment", "opportunity_name"], ["assessment"]], "assessment", "opportunity_name").agg(
        F.count_distinct("flw_id").alias("flws"), F.count("*").alias("batches"), *(F.round(100.0 * is_(x) / F.count("*"), 1).alias(f"pct_{x}") for x in ("all_ok", "before", "first", "repeat", "after")),
        F.round(100.0 * ratio(is_("repeat"), is_("repeat") + is_("after"), None), 1).alias("pct_repeat_of_later"),
    )
    return g.withColumn("opportunity", F.coalesce("opportunity_name", F.lit("All Opportunities"))).drop("opportunity_name")


@query("aggr_quality_score", _recursive(BATCH_SQL + ", " + ASSESS_SQL + """, td AS (SELECT MAX(visit_day) AS today FROM answers), rc AS (SELECT flw_id, MAX(visit_day) AS last, COUNT(*) FILTER (WHERE visit_day > today - 7) AS forms, COUNT(DISTINCT case_id) FILTER (WHERE visit_day > today - 7) AS places FROM answers, td GROUP BY flw_id),
wd AS (SELECT flw_id, visit_day, COUNT(*) AS n, date_diff('microsecond', MIN(visit_date), MAX(visit_date)) / 6e7 AS m FROM answers, td WHERE visit_day > today - 7 GROUP BY flw_id, visit_day), mn AS (SELECT flw_id, SUM(m) / SUM(n) AS minutes FROM wd WHERE n > 1 GROUP BY flw_id),
lt AS (SELECT flw_id, assessment, arg_max(result, CAST(batch AS BIGINT)) AS result FROM ass WHERE batch <> 'all' GROUP BY ALL), gd AS (SELECT MAX(checked_in_date) AS g FROM dus),
cp AS (SELECT flw_id, MAX(delivery_count * 1.0 / buildings) AS r FROM dus, gd WHERE buildings > 0 AND checked_in_date > g - INTERVAL 7 DAYS GROUP BY flw_id)
SELECT rc.flw_id, CASE WHEN today - last < 7 THEN 10 ELSE 0 END + CASE WHEN forms / 7.0 > 10 THEN 10 ELSE 0 END + CASE WHEN places / 7.0 > 1 THEN 10 ELSE 0 END + CASE WHEN minutes > 3 THEN 10 ELSE 0 END
 + 15 * CAST((SELECT COUNT(*) FROM lt WHERE lt.flw_id = rc.flw_id AND result <> 'strong_negative') AS INT) + CASE WHEN r <= 10 THEN 15 ELSE 0 END AS score FROM rc JOIN td ON true LEFT JOIN mn USING (flw_id) LEFT JOIN cp ON cp.flw_id = rc.flw_id"""))
def quality_score(spark: SparkSession, d: str) -> DataFrame:
    """The weekly score by eight rules: activity, forms, places and minutes of seven days, three assessments of the latest
    batch, and units with over ten deliveries for each building. Null where no rule has anything to go by."""
    v = answers(spark, d)
    today = F.broadcast(v.agg(F.max("visit_day").alias("today")))
    recent = F.col("visit_day") > F.date_sub("today", 7)
    week = v.join(today)
    act = week.groupBy("flw_id").agg(F.max(F.col("today")).alias("today"), F.max("visit_day").alias("last"), F.count_if(recent).alias("forms"), F.count_distinct(F.when(recent, F.col("case_id"))).alias("places"))
    days = week.where(recent).groupBy("flw_id", "visit_day").agg(F.count("*").alias("n"), minutes_between(F.min("visit_date"), F.max("visit_date")).alias("m")).where("n > 1")
    minutes = days.groupBy("flw_id").agg((F.sum("m") / F.sum("n")).alias("minutes"))
    latest = assessed(v).where("batch <> 'all'").groupBy("flw_id", "assessment").agg(F.max_by("result", F.col("batch").cast("bigint")).alias("result"))
    fine = latest.groupBy("flw_id").agg(F.count_if(F.col("result") != "strong_negative").alias("fine"), F.count("*").alias("known"))
    dus = delivery_units(spark, d)
    newest = F.broadcast(dus.agg(F.max("checked_in_date").alias("g")))
    camping = dus.join(newest).where((F.col("buildings") > 0) & (F.col("checked_in_date") > F.col("g") - F.expr("INTERVAL 7 DAYS"))).groupBy(F.col("flw_id").cast("bigint").alias("flw_id")).agg(F.max(F.col("delivery_count") / F.col("buildings")).alias("r"))
    j = act.join(minutes, "flw_id", "left").join(fine, "flw_id", "left").join(camping, "flw_id", "left")
    rules = ((F.date_diff("today", "last"), lambda x: x < 7, 10), (F.col("forms") / 7.0, lambda x: x > 10, 10), (F.col("places") / 7.0, lambda x: x > 1, 10), (F.col("minutes"), lambda x: x > 3, 10), (F.col("r"), lambda x: x <= 10, 15))
    total = sum((F.when(test(x), points).otherwise(0) for x, test, points in rules), F.lit(0)) + 15 * F.coalesce("fine", F.lit(0)).cast("int")
    applies = sum((x.isNotNull().cast("int") for x, _, _ in rules), F.lit(0)) + F.coalesce("known", F.lit(0))
    return j.select("flw_id", F.when(applies > 0, total).alias("score"))


@query("aggr_camping_class", with_views("gd AS (SELECT MAX(checked_in_date) AS g FROM dus), r AS (SELECT flw_id, MAX(delivery_count * 1.0 / buildings) AS r FROM dus, gd WHERE buildings > 0 AND checked_in_date > g - INTERVAL 7 DAYS GROUP BY flw_id) SELECT flw_id, CASE WHEN r > 20 THEN 'Camping ++' WHEN r > 10 THEN 'Camping +' ELSE '' END AS camping FROM r"))
def camping_class(spark: SparkSession, d: str) -> DataFrame:
    """The worst class of deliveries for each building among a worker's units of the last seven days."""
    dus = delivery_units(spark, d)
    newest = F.broadcast(dus.agg(F.max("checked_in_date").alias("g")))
    r = dus.join(newest).where((F.col("buildings") > 0) & (F.col("checked_in_date") > F.col("g") - F.expr("INTERVAL 7 DAYS"))).groupBy("flw_id").agg(F.max(F.col("delivery_count") / F.col("buildings")).alias("r"))
    return r.select("flw_id", F.when(F.col("r") > 20, "Camping ++").when(F.col("r") > 10, "Camping +").otherwise("").alias("camping"))
