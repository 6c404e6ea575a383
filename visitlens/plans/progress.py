"""Progress by day: deliveries and completed units with look-back counts, and wards against their targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visitlens.operators.lookback import distinct_in_range
from visitlens.registry import query
from visitlens.sources.views import delivery_units, visits, with_views

#: Services for each building beyond which a unit is clumped, and days that are looked back on (fixed values).
CLUMPED, LOOKBACK = 10.0, 10

_SERIES_SQL = f"""v AS (SELECT opportunity_id AS o, visit_day AS day, COUNT(*) AS n FROM visits GROUP BY ALL),
du AS (SELECT service_area_id % 5 AS o, CAST(checked_out_date AS DATE) AS day, flw_id, buildings, delivery_count AS services,
    COALESCE(delivery_count / NULLIF(buildings, 0) > {CLUMPED}, false) AS clumped
  FROM dus WHERE status = 'completed' AND checked_out_date IS NOT NULL),
span AS (SELECT o, MIN(day) AS a, MAX(day) AS b, MAX(day) FILTER (WHERE clumped) AS c FROM du GROUP BY o),
s1 AS (SELECT o, CAST(UNNEST(generate_series(MIN(day), MAX(day), INTERVAL 1 DAY)) AS DATE) AS day FROM v GROUP BY o),
s2 AS (SELECT o, CAST(UNNEST(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM span),
s3 AS (SELECT o, CAST(UNNEST(generate_series(a, c, INTERVAL 1 DAY)) AS DATE) AS day FROM span WHERE c IS NOT NULL),
d AS (SELECT o, day, COUNT(*) AS n, COUNT(*) FILTER (WHERE clumped) AS clumped, SUM(services) AS services, SUM(buildings) AS buildings FROM du GROUP BY ALL),
r AS (SELECT o, day, services, buildings, SUM(services) OVER w AS all_services, SUM(buildings) OVER w AS all_buildings FROM d WINDOW w AS (PARTITION BY o ORDER BY day)),
x AS (
  SELECT s1.o, 'service_delivery' AS series, s1.day, COALESCE(n, 0)::DOUBLE AS daily, SUM(COALESCE(n, 0)) OVER (PARTITION BY s1.o ORDER BY s1.day)::DOUBLE AS cumulative, NULL::BIGINT AS workers
  FROM s1 LEFT JOIN v ON v.o = s1.o AND v.day = s1.day
  UNION ALL SELECT s2.o, 'du_completion', s2.day, COALESCE(n, 0), SUM(COALESCE(n, 0)) OVER (PARTITION BY s2.o ORDER BY s2.day), NULL
  FROM s2 LEFT JOIN d ON d.o = s2.o AND d.day = s2.day
  UNION ALL SELECT s3.o, 'clumped_dus', s3.day, COALESCE(clumped, 0), SUM(COALESCE(clumped, 0)) OVER (PARTITION BY s3.o ORDER BY s3.day), COALESCE(workers, 0)
  FROM s3 LEFT JOIN d ON d.o = s3.o AND d.day = s3.day LEFT JOIN (
    SELECT s3.o, s3.day, COUNT(DISTINCT flw_id) AS workers FROM s3 JOIN du ON du.o = s3.o AND clumped AND du.day BETWEEN s3.day - {LOOKBACK - 1} AND s3.day GROUP BY ALL) k
    ON k.o = s3.o AND k.day = s3.day
  UNION ALL SELECT o, 'service_to_building_ratio', day, COALESCE(services / NULLIF(buildings, 0), 0), COALESCE(all_services / NULLIF(all_buildings, 0), 0), NULL FROM r)
SELECT x.o AS opportunity, series, CAST(date_diff('day', CASE WHEN series = 'service_delivery' THEN m.a ELSE span.a END, x.day) AS BIGINT) AS day,
  ROUND(daily, 6) AS daily, ROUND(cumulative, 6) AS cumulative, workers
FROM x LEFT JOIN span ON span.o = x.o LEFT JOIN (SELECT o, MIN(day) AS a FROM v GROUP BY o) m ON m.o = x.o"""


def _running(c: str) -> Column:
    return F.sum(c).over(Window.partitionBy("o").orderBy("day").rowsBetween(Window.unboundedPreceding, 0))


def _days(spans: DataFrame, low: str, high: str) -> DataFrame:
    return spans.where(F.col(high).isNotNull()).select("o", F.explode(F.sequence(low, high)).alias("day"))


def progress_series(deliveries: DataFrame, units: DataFrame, clumped: float = CLUMPED, lookback: int = LOOKBACK) -> DataFrame:
    """(o, series, day, daily, cumulative, workers) of deliveries (o, day, n) and completed units (o, day, flw_id, buildings, services).

    Deliveries, completions and clumped completions on every day from the first one (of completions, for clumped ones too) to
    the last; services for each building on days of completions only. workers: those who completed clumped units in the last
    `lookback` days. Days are numbered from the first.
    """
    is_clumped = F.coalesce(F.col("services") / F.nullif("buildings", F.lit(0)) > clumped, F.lit(False))
    units = units.withColumn("clumped", is_clumped)
    spans = units.groupBy("o").agg(F.min("day").alias("a"), F.max("day").alias("b"), F.max(F.when(F.col("clumped"), F.col("day"))).alias("c"))
    by_day = units.groupBy("o", "day").agg(F.count("*").alias("n"), F.count_if("clumped").alias("m"), F.sum("services").alias("services"), F.sum("buildings").alias("buildings"))
    first = deliveries.groupBy("o").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    none = F.lit(None).cast("bigint")

    def series(name: str, rows: DataFrame, daily: Column, cumulative: Column, workers: Column = none) -> DataFrame:
        return rows.select("o", F.lit(name).alias("series"), "day", daily.cast("double").alias("daily"), cumulative.cast("double").alias("cumulative"), workers.alias("workers"))

    counted = lambda days, counts, c: days.join(counts.select("o", "day", c), ["o", "day"], "left").fillna(0, [c])
    delivered = series("service_delivery", counted(_days(first, "a", "b"), deliveries, "n"), F.col("n"), _running("n"))
    completed = series("du_completion", counted(_days(spans, "a", "b"), by_day, "n"), F.col("n"), _running("n"))
    looked = distinct_in_range(units.where("clumped"), counted(_days(spans, "a", "c"), by_day, "m"), ["o"], "flw_id", "day", lookback, "w")
    clumps = series("clumped_dus", looked, F.col("m"), _running("m"), F.col("w"))
    ratios = series("service_to_building_ratio", by_day, ratio(F.col("services"), F.col("buildings")), ratio(_running("services"), _running("buildings")))
    start = first.select("o", F.lit(True).alias("of_deliveries"), F.col("a").alias("start")).unionByName(spans.select("o", F.lit(False).alias("of_deliveries"), F.col("a").alias("start")))
    every = delivered.unionByName(completed).unionByName(clumps).unionByName(ratios).withColumn("of_deliveries", F.col("series") == "service_delivery")
    return every.join(start, ["o", "of_deliveries"]).select("o", "series", F.datediff("day", "start").cast("bigint").alias("day"), "daily", "cumulative", "workers")


@query("win_progress_series", with_views(_SERIES_SQL))
def progress(spark: SparkSession, d: str) -> DataFrame:
    deliveries = visits(spark, d).groupBy(F.col("opportunity_id").alias("o"), F.col("visit_day").alias("day")).agg(F.count("*").alias("n"))
    units = delivery_units(spark, d).where("status = 'completed' AND checked_out_date IS NOT NULL")
    units = units.select((F.col("service_area_id") % 5).cast("bigint").alias("o"), F.to_date("checked_out_date").alias("day"), "flw_id", "buildings", F.col("delivery_count").alias("services"))
    return progress_series(deliveries, units).select(F.col("o").alias("opportunity"), "series", "day", F.round("daily", 6).alias("daily"), F.round("cumulative", 6).alias("cumulative"), "workers")


#: A case's ward and whether its unit is completed; a ward's targets (ward 2 has none).
_WARD, _DONE = "case_id % 3", "case_id % 4 <> 0"
_TARGETS_SQL = "t(ward, visit_target, du_target, building_target) AS (VALUES (0, 400, 60, 90), (1, 150, 0, 45))"
_SHARES = {"visits": "visit_target", "dus": "du_target", "buildings": "building_target"}


def _pct_sql(count: str, target: str) -> str:
    return f"COALESCE(100.0::DOUBLE * {count} / NULLIF({target}, 0), 0)"


_WARD_SQL = f"""{_TARGETS_SQL}, w AS (SELECT opportunity_id AS domain, {_WARD} AS ward, visit_day AS day, case_id, {_DONE} AS done FROM visits),
days AS (SELECT DISTINCT domain, day FROM w), wards AS (SELECT DISTINCT domain, ward FROM w),
c AS (SELECT days.domain, wards.ward, days.day,
    COUNT(*) FILTER (WHERE w.day <= days.day) AS visits, COUNT(*) FILTER (WHERE w.day BETWEEN days.day - 7 AND days.day) AS visits_week,
    COUNT(DISTINCT CASE WHEN done AND w.day <= days.day THEN case_id END) AS dus, COUNT(DISTINCT CASE WHEN done AND w.day BETWEEN days.day - 7 AND days.day THEN case_id END) AS dus_week
  FROM days JOIN wards ON wards.domain = days.domain JOIN w ON w.domain = days.domain AND w.ward = wards.ward GROUP BY ALL),
p AS (SELECT c.*, {", ".join(f"{_pct_sql(n + s, t)} AS p_{k}{s}" for k, t in _SHARES.items() for s in ("", "_week") for n in ("visits" if k == "visits" else "dus",))}
  FROM c LEFT JOIN t ON t.ward = c.ward)
SELECT domain, ward, day, visits AS visits_so_far, dus AS dus_so_far, dus AS buildings_so_far, visits_week, dus_week, dus_week AS buildings_week,
  {", ".join(f"ROUND(p_{k}{s}, 2) AS pct_{k}{s}" for k in _SHARES for s in ("", "_week"))},
  {", ".join(f"ROUND(COALESCE(100 * p_{k}{s} / NULLIF(p_visits{s}, 0), 0), 6) AS {k}_planning_rate{s}" for k in ("dus", "buildings") for s in ("", "_week"))} FROM p"""


@query("win_ward_timeline", with_views(_WARD_SQL))
def ward_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Every ward of a domain on every day that the domain has visits: visits and distinct completed cases so far and in the
    week that ends then (eight days), as shares of the ward's targets (0 without), and completions for each share of visits."""
    key = ["domain", "ward"]
    v = visits(spark, d).select(F.col("opportunity_id").alias("domain"), F.expr(_WARD).alias("ward"), F.col("visit_day").alias("day"), "case_id", F.expr(_DONE).alias("done"))
    n = v.groupBy(*key, "day").agg(F.count("*").alias("n"))
    done = v.where("done")
    fresh = done.groupBy(*key, "case_id").agg(F.min("day").alias("day")).groupBy(*key, "day").agg(F.count("*").alias("fresh"))
    grid = v.select("domain", "day").distinct().join(v.select("domain", "ward").distinct(), "domain")
    g = grid.join(n, [*key, "day"], "left").join(fresh, [*key, "day"], "left").fillna(0, ["n", "fresh"])
    upto = Window.partitionBy(*key).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    week = Window.partitionBy(*key).orderBy(F.datediff("day", F.lit("1970-01-01"))).rangeBetween(-7, 0)
    g = g.select(*key, "day", F.sum("n").over(upto).alias("visits"), F.sum("fresh").over(upto).alias("dus"), F.sum("n").over(week).alias("visits_week"))
    g = distinct_in_range(done, g, key, "case_id", "day", 8, "dus_week").fillna(0, ["dus_week"])
    targets = spark.createDataFrame([(0, 400, 60, 90), (1, 150, 0, 45)], "ward bigint, visit_target bigint, du_target bigint, building_target bigint")
    g = g.join(F.broadcast(targets), "ward", "left")
    share = lambda c, t: F.coalesce(100.0 * F.col(c) / F.nullif(t, F.lit(0)), F.lit(0.0))
    g = g.select("*", *(share(("visits" if k == "visits" else "dus") + s, t).alias(f"p_{k}{s}") for k, t in _SHARES.items() for s in ("", "_week")))
    rate = lambda k, s: F.coalesce(100 * F.col(f"p_{k}{s}") / F.nullif(f"p_visits{s}", F.lit(0.0)), F.lit(0.0))
    return g.select(
        *key, "day", F.col("visits").alias("visits_so_far"), F.col("dus").alias("dus_so_far"), F.col("dus").alias("buildings_so_far"), "visits_week", "dus_week", F.col("dus_week").alias("buildings_week"),
        *(F.round(f"p_{k}{s}", 2).alias(f"pct_{k}{s}") for k in _SHARES for s in ("", "_week")), *(F.round(rate(k, s), 6).alias(f"{k}_planning_rate{s}") for k in ("dus", "buildings") for s in ("", "_week")),
    )


_COUNTRY, _PARTNER = "opportunity_id % 2", "flw_id % 6"
#: Rows, columns and what is listed or counted beside them, of each of the four tables.
_PIVOTS = {
    "monthly_by_country": ("country", "month", "kinds", "partners"), "monthly_by_partner": ("partner", "month", "countries", "kinds"),
    "monthly_by_kind": ("kind", "month", "countries", "partners"), "partner_by_kind": ("partner", "kind", "countries", None),
}
_NOTES_SQL = {
    "kinds": "string_agg(DISTINCT kind, ', ' ORDER BY kind)", "countries": "string_agg(DISTINCT country, ', ' ORDER BY country)", "partners": "CAST(COUNT(DISTINCT partner) AS VARCHAR)",
}


def _pivot_sql(name: str, row: str, col: str, one: str, two: str | None) -> str:
    notes = f"SELECT {row}, {_NOTES_SQL[one]} AS one, {_NOTES_SQL[two] if two else 'NULL'} AS two FROM y GROUP BY {row}"
    return f"""SELECT '{name}' AS report, COALESCE(g.r, 'TOTAL') AS row_name, COALESCE(g.c, 'TOTAL') AS column_name, CAST(COALESCE(n, 0) AS BIGINT) AS visits,
  COALESCE(one, '') AS first_note, COALESCE(two, '') AS second_note
FROM (SELECT r, c FROM (SELECT DISTINCT {row} AS r FROM y UNION ALL SELECT NULL), (SELECT DISTINCT {col} AS c FROM y UNION ALL SELECT NULL)) g
LEFT JOIN (SELECT {row} AS r, {col} AS c, COUNT(*) AS n FROM y GROUP BY CUBE ({row}, {col})) k ON k.r IS NOT DISTINCT FROM g.r AND k.c IS NOT DISTINCT FROM g.c
LEFT JOIN ({notes}) o ON o.{row} = g.r"""


@query("aggr_monthly_pivots", with_views(f"""y AS (SELECT concat('country_', {_COUNTRY}) AS country, concat('partner_', {_PARTNER}) AS partner, event_type AS kind, strftime(visit_date, '%Y-%m') AS month FROM visits)
""" + " UNION ALL ".join(_pivot_sql(k, *v) for k, v in _PIVOTS.items())))
def monthly_pivots(spark: SparkSession, d: str) -> DataFrame:
    """Four tables of counts with totals of rows and columns, and beside each row what it has of other things: one row for each cell."""
    y = visits(spark, d).select(F.concat(F.lit("country_"), F.expr(_COUNTRY)).alias("country"), F.concat(F.lit("partner_"), F.expr(_PARTNER)).alias("partner"), F.col("event_type").alias("kind"), F.date_format("visit_date", "yyyy-MM").alias("month"))
    few = y.groupBy("country", "partner", "kind", "month").agg(F.count("*").alias("n"))  # all that the tables need, once
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ", ")
    notes = {"kinds": listed("kind"), "countries": listed("country"), "partners": F.count_distinct("partner").cast("string")}
    out = None
    for name, (row, col, one, two) in _PIVOTS.items():
        cube = few.cube(row, col).agg(F.sum("n").alias("n"), F.grouping(row).alias("gr"), F.grouping(col).alias("gc"))
        cube = cube.select(F.when(F.col("gr") == 1, "TOTAL").otherwise(F.col(row)).alias("row_name"), F.when(F.col("gc") == 1, "TOTAL").otherwise(F.col(col)).alias("column_name"), "n")
        # Names of columns (months, kinds) are few: one array of them goes to every row.
        columns = F.broadcast(few.agg(F.concat(F.collect_set(col), F.array(F.lit("TOTAL"))).alias("columns")))
        rows = few.groupBy(row).agg(F.lit(1).alias("any")).select(F.col(row).alias("row_name")).unionByName(few.agg(F.lit("TOTAL").alias("row_name")))
        grid = rows.join(columns).select("row_name", F.explode("columns").alias("column_name"))
        beside = few.groupBy(F.col(row).alias("row_name")).agg(notes[one].alias("one"), (notes[two] if two else F.lit("")).alias("two"))
        part = grid.join(cube, ["row_name", "column_name"], "left").join(beside, "row_name", "left")
        part = part.select(F.lit(name).alias("report"), "row_name", "column_name", F.coalesce("n", F.lit(0)).alias("visits"), F.coalesce("one", F.lit("")).alias("first_note"), F.coalesce("two", F.lit("")).alias("second_note"))
        out = part if out is None else out.unionByName(part)
    return out
