"""Delivery units, service areas, targets and flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visitlens.functions.columns import percent, ratio
from visitlens.registry import query
from visitlens.sources.views import delivery_units, table, visits, with_views

STATUSES = ("completed", "visited", "unvisited")


@query("aggr_du_status_counts", with_views("SELECT flw_id, " + ", ".join(f"COUNT(*) FILTER (WHERE status = '{s}') AS {s}" for s in STATUSES) + ", COUNT(*) AS total FROM dus GROUP BY flw_id"))
def du_status_counts(spark: SparkSession, d: str) -> DataFrame:
    wide = delivery_units(spark, d).groupBy("flw_id").pivot("status", list(STATUSES)).count().fillna(0)
    return wide.withColumn("total", F.col("completed") + F.col("visited") + F.col("unvisited"))


@query("aggr_project_totals", with_views("""SELECT COUNT(*) AS dus, CAST(SUM(buildings) AS BIGINT) AS buildings, CAST(SUM(delivery_count) AS BIGINT) AS deliveries, COUNT(*) FILTER (WHERE status = 'completed') AS completed,
 COUNT(*) FILTER (WHERE status = 'unvisited') AS unvisited, COUNT(*) FILTER (WHERE status IS NULL) AS without_status, ROUND(100.0 * COUNT(*) FILTER (WHERE status = 'completed') / COUNT(*), 6) AS completed_pct FROM dus"""))
def project_totals(spark: SparkSession, d: str) -> DataFrame:
    """Whole-project totals; units without a status are counted apart from unvisited ones."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    return delivery_units(spark, d).agg(
        F.count("*").alias("dus"), F.sum("buildings").alias("buildings"), F.sum("delivery_count").alias("deliveries"), is_("completed").alias("completed"),
        is_("unvisited").alias("unvisited"), F.count_if(F.col("status").isNull()).alias("without_status"), F.round(100.0 * is_("completed") / F.count("*"), 6).alias("completed_pct"),
    )


@query("aggr_service_area_rollup", with_views("""SELECT service_area_id, COUNT(*) AS dus, COUNT(*) FILTER (WHERE status = 'completed') AS completed, ROUND(100.0 * COUNT(*) FILTER (WHERE status = 'completed') / COUNT(*), 4) AS completed_pct,
 CAST(SUM(buildings) AS BIGINT) AS buildings, ROUND(COALESCE(SUM(buildings) / NULLIF(SUM(surface_area) / 1e6, 0), 0), 6) AS density, MAX(checked_out_date) AS last_activity FROM dus GROUP BY service_area_id"""))
def service_area_rollup(spark: SparkSession, d: str) -> DataFrame:
    return delivery_units(spark, d).groupBy("service_area_id").agg(
        F.count("*").alias("dus"), F.count_if(F.col("status") == "completed").alias("completed"), F.round(percent(F.count_if(F.col("status") == "completed"), F.count("*")), 4).alias("completed_pct"),
        F.sum("buildings").alias("buildings"), F.round(ratio(F.sum("buildings"), F.sum("surface_area") / 1e6), 6).alias("density"), F.max("checked_out_date").alias("last_activity"),
    )


@query("aggr_building_density", with_views("""SELECT flw_id, service_area_id, CAST(SUM(buildings) AS BIGINT) AS buildings, ROUND(COALESCE(SUM(buildings) / NULLIF(SUM(surface_area) / 1e6, 0), 0), 6) AS density FROM dus GROUP BY GROUPING SETS ((service_area_id), (flw_id, service_area_id))"""))
def building_density(spark: SparkSession, d: str) -> DataFrame:
    """Per area and per worker and area, by one pass of grouping sets."""
    g = delivery_units(spark, d).groupingSets([["service_area_id"], ["flw_id", "service_area_id"]], "flw_id", "service_area_id")
    return g.agg(F.sum("buildings").alias("buildings"), F.round(ratio(F.sum("buildings"), F.sum("surface_area") / 1e6), 6).alias("density"))


@query("aggr_flw_area_stats", with_views("""SELECT flw_id, service_area_id, COUNT(*) AS dus, COUNT(*) FILTER (WHERE status = 'completed') AS completed, ROUND(100.0 * COUNT(*) FILTER (WHERE status = 'completed') / COUNT(*), 4) AS completed_pct,
 ROUND(SUM(surface_area) / 1e6, 6) AS area FROM dus GROUP BY ALL"""))
def flw_area_stats(spark: SparkSession, d: str) -> DataFrame:
    done = F.count_if(F.col("status") == "completed")
    return delivery_units(spark, d).groupBy("flw_id", "service_area_id").agg(F.count("*").alias("dus"), done.alias("completed"), F.round(percent(done, F.count("*")), 4).alias("completed_pct"), F.round(F.sum("surface_area") / 1e6, 6).alias("area"))


@query("aggr_checkin_days", with_views("SELECT flw_id, COUNT(DISTINCT CAST(checked_in_date AS DATE)) AS days, MIN(checked_in_date) AS first_in, MAX(checked_in_date) AS last_in FROM dus GROUP BY flw_id"))
def checkin_days(spark: SparkSession, d: str) -> DataFrame:
    return delivery_units(spark, d).groupBy("flw_id").agg(F.count_distinct(F.col("checked_in_date").cast("date")).alias("days"), F.min("checked_in_date").alias("first_in"), F.max("checked_in_date").alias("last_in"))


@query("aggr_du_completion_date", """WITH o AS (SELECT o_orderkey, o_orderdate, MIN(l_shipdate) AS first_visit, COALESCE(SUM(l_quantity), 0) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY ALL)
SELECT o_orderkey AS du_name, CASE WHEN n = 0 THEN o_orderdate ELSE first_visit END AS completed_at FROM o""")
def du_completion_date(spark: SparkSession, d: str) -> DataFrame:
    """A completed unit's date: its check-in where nothing was delivered, else the first visit."""
    o = table(spark, d, "orders").where("o_orderstatus = 'F'")
    visits_ = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first_visit"), F.sum("l_quantity").alias("n"))
    j = o.join(visits_, o.o_orderkey == visits_.l_orderkey, "left")
    return j.select(F.col("o_orderkey").alias("du_name"), F.when(F.coalesce("n", F.lit(0.0)) == 0, F.col("o_orderdate")).otherwise(F.col("first_visit")).alias("completed_at"))


#: Texts of two further dates of a unit: some are missing, some in another zone, some no date.
_MODIFIED = "CASE WHEN du_name % 5 = 0 THEN 'soon' WHEN du_name % 7 = 0 THEN NULL ELSE concat(CAST(CAST(checked_in_date AS DATE) AS {text}), 'T09:30:00Z') END"
_COMPUTED = "CASE WHEN status = 'completed' THEN concat(CAST(CAST(checked_out_date AS DATE) AS {text}), CASE WHEN du_name % 2 = 0 THEN 'T01:00:00+02:00' ELSE ' 23:59:59' END) WHEN du_name % 3 = 0 THEN '' END"


@query("scal_last_activity", with_views(f"""t AS (SELECT du_name, CAST(checked_in_date AS TIMESTAMP) AS a, CAST(checked_out_date AS TIMESTAMP) AS b,
  {_MODIFIED.format(text="VARCHAR")} AS modified, {_COMPUTED.format(text="VARCHAR")} AS computed FROM dus)
SELECT du_name, GREATEST(a, b, TRY_CAST(regexp_replace(modified, '(Z|[+-]\\d\\d:\\d\\d)$', '') AS TIMESTAMP), TRY_CAST(regexp_replace(computed, '(Z|[+-]\\d\\d:\\d\\d)$', '') AS TIMESTAMP)) AS last_activity FROM t"""))
def last_activity(spark: SparkSession, d: str) -> DataFrame:
    """The latest of four dates: zones are dropped, not applied; what is missing or no date is left out."""
    own = delivery_units(spark, d).select("du_name", "checked_in_date", "checked_out_date", F.expr(_MODIFIED.format(text="STRING")).alias("modified"), F.expr(_COMPUTED.format(text="STRING")).alias("computed"))
    parsed = lambda c: F.try_to_timestamp(F.regexp_replace(c, r"(Z|[+-]\d\d:\d\d)$", "")).cast("timestamp_ntz")
    given = lambda c: F.col(c).cast("timestamp_ntz")
    return own.select("du_name", F.greatest(given("checked_in_date"), given("checked_out_date"), parsed("modified"), parsed("computed")).alias("last_activity"))


@query("aggr_camping_flags", with_views("""SELECT du_name, CAST(round_even(delivery_count * 1.0 / buildings, 0) AS BIGINT) AS per_building, round_even(delivery_count * 1.0 / buildings, 0) >= 12 AND delivery_count > 20 AS is_camping,
 date_diff('day', CAST(checked_in_date AS DATE), CAST(checked_out_date AS DATE)) AS days_in_du FROM dus WHERE buildings > 0"""))
def camping_flags(spark: SparkSession, d: str) -> DataFrame:
    per = F.bround(F.col("delivery_count") / F.col("buildings"), 0)
    return delivery_units(spark, d).where("buildings > 0").select(
        "du_name", per.cast("bigint").alias("per_building"), ((per >= 12) & (F.col("delivery_count") > 20)).alias("is_camping"), F.date_diff(F.col("checked_out_date").cast("date"), F.col("checked_in_date").cast("date")).cast("bigint").alias("days_in_du")
    )


@query("aggr_target_completion", with_views("""SELECT n.n_name AS area, COUNT(*) FILTER (WHERE status = 'completed') AS completed, COUNT(*) AS du_target, ROUND(100.0 * COUNT(*) FILTER (WHERE status = 'completed') / COUNT(*), 4) AS completion_pct,
 COUNT(*) FILTER (WHERE status = 'completed' AND checked_in_date >= (SELECT MAX(o_orderdate) FROM orders) - INTERVAL 7 DAY) AS completed_last_week, COUNT(DISTINCT flw_id) AS users FROM dus JOIN nation n ON n.n_nationkey = service_area_id GROUP BY n.n_name"""))
def target_completion(spark: SparkSession, d: str) -> DataFrame:
    """Completed units against the area's target, over all time and in the last week."""
    x = delivery_units(spark, d)
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("service_area_id"), F.col("n_name").alias("area"))
    last = F.broadcast(x.agg(F.max("checked_in_date").alias("latest")))
    done = F.col("status") == "completed"
    return x.join(names, "service_area_id").join(last).groupBy("area").agg(
        F.count_if(done).alias("completed"), F.count("*").alias("du_target"), F.round(percent(F.count_if(done), F.count("*")), 4).alias("completion_pct"),
        F.count_if(done & (F.col("checked_in_date") >= F.col("latest") - F.expr("INTERVAL 7 DAYS"))).alias("completed_last_week"), F.count_distinct("flw_id").alias("users"),
    )


@query("aggr_delivery_target_pct", with_views("SELECT du_name, ROUND(COALESCE(100.0 * delivery_count / NULLIF(buildings, 0), 0), 6) AS completion_pct FROM dus"))
def delivery_target_pct(spark: SparkSession, d: str) -> DataFrame:
    return delivery_units(spark, d).select("du_name", F.round(percent("delivery_count", "buildings"), 6).alias("completion_pct"))


@query("aggr_flag_rollup", with_views("""f AS (SELECT flw_id, k > 80 AS high_k, unwell = 'yes' AS unwell, status = 'rejected' AS rejected, CAST(visit_day AS DATE) > (SELECT MAX(visit_day) FROM visits) - 7 AS recent FROM visits)
SELECT flw_id, bool_or(high_k) AS any_high_k, COUNT(*) FILTER (WHERE rejected) AS rejected, COUNT(*) FILTER (WHERE rejected AND recent) AS rejected_7d,
 MAX(CASE WHEN rejected THEN 3 WHEN high_k THEN 2 WHEN unwell THEN 1 ELSE 0 END) AS priority,
 concat_ws(', ', CASE WHEN bool_or(rejected) THEN 'rejected' END, CASE WHEN bool_or(high_k) THEN 'high k' END, CASE WHEN bool_or(unwell) THEN 'unwell' END) AS flags FROM f GROUP BY flw_id"""))
def flag_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Flags of visits gathered per worker: any, worst, counts in all and in the last week, and a list."""
    v = visits(spark, d)
    f = v.join(F.broadcast(v.agg(F.max("visit_day").alias("today")))).select(
        "flw_id", (F.col("k") > 80).alias("high_k"), (F.col("unwell") == "yes").alias("unwell"), (F.col("status") == "rejected").alias("rejected"), (F.col("visit_day") > F.date_sub("today", 7)).alias("recent")
    )
    priority = F.when(F.col("rejected"), 3).when(F.col("high_k"), 2).when(F.col("unwell"), 1).otherwise(0)
    name = lambda c, text: F.when(F.bool_or(c), F.lit(text))
    return f.groupBy("flw_id").agg(
        F.bool_or("high_k").alias("any_high_k"), F.count_if("rejected").alias("rejected"), F.count_if(F.col("rejected") & F.col("recent")).alias("rejected_7d"),
        F.max(priority).alias("priority"), F.concat_ws(", ", name("rejected", "rejected"), name("high_k", "high k"), name("unwell", "unwell")).alias("flags"),
    )


@query("join_left_dims", "SELECT l_orderkey, l_linenumber, c_name, n_name, r_name FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE r_name LIKE 'A%'")
def left_dims(spark: SparkSession, d: str) -> DataFrame:
    """A chain of left joins with a filter on the last table, which makes them inner."""
    li, o, c, n, r = (table(spark, d, x) for x in ("lineitem", "orders", "customer", "nation", "region"))
    j = li.join(o, li.l_orderkey == o.o_orderkey, "left").join(c, o.o_custkey == c.c_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    return j.where(F.col("r_name").like("A%")).select("l_orderkey", "l_linenumber", "c_name", "n_name", "r_name")


@query("join_fan_out", with_views("""u AS (SELECT DISTINCT opportunity_id, flw_id, flw_name FROM visits), n AS (SELECT opportunity_id, COUNT(*) AS n, MAX(flw_name) AS some_name FROM visits GROUP BY opportunity_id)
SELECT u.opportunity_id, u.flw_id, n.n AS joined_rows, n.some_name AS any_name FROM u LEFT JOIN n USING (opportunity_id)"""))
def fan_out(spark: SparkSession, d: str) -> DataFrame:
    """Every user against all visits of the opportunity, collapsed by user: visits are summed before the join, so nothing fans out."""
    v = visits(spark, d)
    users = v.select("opportunity_id", "flw_id").distinct()
    totals = v.groupBy("opportunity_id").agg(F.count("*").alias("joined_rows"), F.max("flw_name").alias("any_name"))
    return users.join(totals, "opportunity_id", "left")


@query("join_key_lookup", with_views("SELECT v.visit_id, d.status AS du_status, d.buildings FROM visits v JOIN dus d ON d.du_name = v.visit_id"))
def key_lookup(spark: SparkSession, d: str) -> DataFrame:
    v, u = visits(spark, d), delivery_units(spark, d)
    return v.join(u, v.visit_id == u.du_name).select("visit_id", u.status.alias("du_status"), "buildings")


@query("join_full_outer_chain", with_views("""a AS (SELECT flw_id, COUNT(*) AS visits FROM visits WHERE status = 'approved' GROUP BY flw_id), b AS (SELECT flw_id, COUNT(*) AS dus FROM dus GROUP BY flw_id), c AS (SELECT flw_id, MAX(k) AS top FROM visits WHERE status = 'rejected' GROUP BY flw_id)
SELECT CAST(flw_id AS VARCHAR) AS flw_id, visits, dus, top FROM a FULL JOIN b USING (flw_id) FULL JOIN c USING (flw_id)"""))
def full_outer_chain(spark: SparkSession, d: str) -> DataFrame:
    """Three per-worker tables merged on a text key, whichever has the worker."""
    v = visits(spark, d)
    text = F.col("flw_id").cast("string").alias("flw_id")
    a = v.where("status = 'approved'").groupBy(text).agg(F.count("*").alias("visits"))
    b = delivery_units(spark, d).groupBy(text).agg(F.count("*").alias("dus"))
    c = v.where("status = 'rejected'").groupBy(text).agg(F.max("k").alias("top"))
    return a.join(b, "flw_id", "full").join(c, "flw_id", "full")


@query("join_metrics_outer", with_views("""a AS (SELECT flw_id, COUNT(*) AS visits, MAX(visit_date) AS last_visit FROM visits GROUP BY flw_id), b AS (SELECT flw_id, COUNT(DISTINCT visit_day) AS approved_days FROM visits WHERE status = 'approved' GROUP BY flw_id)
SELECT flw_id, visits, last_visit, approved_days FROM a FULL JOIN b USING (flw_id)"""))
def metrics_outer(spark: SparkSession, d: str) -> DataFrame:
    v = visits(spark, d)
    a = v.groupBy("flw_id").agg(F.count("*").alias("visits"), F.max("visit_date").alias("last_visit"))
    b = v.where("status = 'approved'").groupBy("flw_id").agg(F.count_distinct("visit_day").alias("approved_days"))
    return a.join(b, "flw_id", "full").orderBy(F.desc("last_visit"), "flw_id")


@query("join_left_chain_fillna", with_views("""SELECT opportunity_id, COUNT(*) AS visits, COUNT(*) FILTER (WHERE status = 'approved') AS approved, COUNT(*) FILTER (WHERE status = 'rejected') AS rejected, COUNT(*) FILTER (WHERE k > 50) AS high FROM visits GROUP BY opportunity_id"""))
def left_chain_fillna(spark: SparkSession, d: str) -> DataFrame:
    """Counts that a chain of left joins would gather, by one aggregation."""
    return visits(spark, d).groupBy("opportunity_id").agg(F.count("*").alias("visits"), F.count_if(F.col("status") == "approved").alias("approved"), F.count_if(F.col("status") == "rejected").alias("rejected"), F.count_if(F.col("k") > 50).alias("high"))


@query("join_semi_completed", with_views("SELECT du_name, status FROM dus WHERE status = 'completed' AND flw_id IN (SELECT flw_id FROM visits WHERE status = 'approved')"))
def semi_completed(spark: SparkSession, d: str) -> DataFrame:
    done = delivery_units(spark, d).where("status = 'completed'")
    return done.join(visits(spark, d).where("status = 'approved'").select("flw_id"), "flw_id", "left_semi").select("du_name", "status")


@query("join_left_then_filter", with_views("SELECT v.visit_id, d.status AS du_status FROM visits v LEFT JOIN dus d ON d.du_name = v.visit_id WHERE v.k > 50 AND d.status IS DISTINCT FROM 'completed'"))
def left_then_filter(spark: SparkSession, d: str) -> DataFrame:
    """A mask over a joined table, taken on the joined rows themselves."""
    v, u = visits(spark, d).where("k > 50"), delivery_units(spark, d)
    return v.join(u, v.visit_id == u.du_name, "left").where(~u.status.eqNullSafe("completed")).select("visit_id", u.status.alias("du_status"))


@query("join_name_fallback", with_views("""n AS (SELECT flw_id, max_by(flw_name, visit_id) AS name FROM visits GROUP BY flw_id) SELECT du_name, COALESCE(n.name, CAST(dus.flw_id AS VARCHAR)) AS worker FROM dus LEFT JOIN n ON n.flw_id = dus.flw_id"""))
def name_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The last name seen of a worker, else the id itself."""
    names = visits(spark, d).groupBy("flw_id").agg(F.max_by("flw_name", "visit_id").alias("name"))
    return delivery_units(spark, d).join(names, "flw_id", "left").select("du_name", F.coalesce("name", F.col("flw_id").cast("string")).alias("worker"))


@query("join_last_wins_map", with_views("SELECT case_id, max_by(flw_name, visit_id) AS flw_name FROM visits GROUP BY case_id"))
def last_wins_map(spark: SparkSession, d: str) -> DataFrame:
    return visits(spark, d).groupBy("case_id").agg(F.max_by("flw_name", "visit_id").alias("flw_name"))


@query("join_anti_unmatched", with_views("SELECT COUNT(*) AS unmatched FROM visits v WHERE NOT EXISTS (SELECT 1 FROM dus d WHERE d.du_name = v.visit_id)"))
def anti_unmatched(spark: SparkSession, d: str) -> DataFrame:
    v, u = visits(spark, d), delivery_units(spark, d)
    return v.join(u, v.visit_id == u.du_name, "left_anti").agg(F.count("*").alias("unmatched"))


@query("join_interval_bins", """WITH e AS (SELECT event_type, MIN(value) AS lo, MAX(value) AS hi FROM events GROUP BY event_type), b AS (SELECT range AS i FROM range(10)),
a AS (SELECT event_type, i, lo + (hi - lo) * i / 10.0 AS x, lo + (hi - lo) * (i + 1) / 10.0 AS y FROM e, b), f AS (SELECT range * 100.0 AS x, range * 100.0 + 100.0 AS y, range AS j FROM range(12))
SELECT event_type, j, ROUND(SUM(GREATEST(0, LEAST(a.y, f.y) - GREATEST(a.x, f.x)) / (a.y - a.x)), 6) AS weight FROM a JOIN f ON a.x < f.y AND f.x < a.y GROUP BY event_type, j""")
def interval_bins(spark: SparkSession, d: str) -> DataFrame:
    """Two sorted bin lists merged by overlap; both have a few dozen rows whatever the data."""
    e = table(spark, d, "events").groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / 10.0
    a = e.select("event_type", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i")).select("event_type", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / 10.0).alias("ax"), (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("i") + 1) / 10.0).alias("ay"))
    f = F.broadcast(spark.range(12).select(F.col("id").alias("j"), (F.col("id") * 100.0).alias("fx"), (F.col("id") * 100.0 + 100.0).alias("fy")))
    overlap = F.greatest(F.lit(0.0), F.least("ay", "fy") - F.greatest("ax", "fx")) / (F.col("ay") - F.col("ax"))
    return a.join(f, (F.col("ax") < F.col("fy")) & (F.col("fx") < F.col("ay"))).groupBy("event_type", "j").agg(F.round(F.sum(overlap), 6).alias("weight"))


def _at_sql(s: int) -> str:
    return f"(SELECT ward_id, COUNT(*) AS cells_{s}00, SUM(p) AS population_{s}00 FROM (SELECT ward_id, row // {s}, col // {s}, SUM(population) AS p FROM cells GROUP BY ALL) GROUP BY ward_id HAVING SUM(p) > {s} * 20)"


@query("join_three_way_compare", with_views(f"SELECT ward_id, cells_100, population_100, cells_200, population_200, cells_300, population_300 FROM {_at_sql(1)} a FULL JOIN {_at_sql(2)} b USING (ward_id) FULL JOIN {_at_sql(3)} c USING (ward_id)"))
def three_way_compare(spark: SparkSession, d: str) -> DataFrame:
    """Wards at three resolutions side by side, each with its own least population: outer joins keep what any of them has."""
    from visitlens.sources.views import cells

    def at(s: int) -> DataFrame:
        parents = cells(spark, d).groupBy("ward_id", F.floor(F.col("row") / s), F.floor(F.col("col") / s)).agg(F.sum("population").alias("p"))
        return parents.groupBy("ward_id").agg(F.count("*").alias(f"cells_{s}00"), F.sum("p").alias(f"population_{s}00")).where(F.col(f"population_{s}00") > s * 20)

    return at(1).join(at(2), "ward_id", "full").join(at(3), "ward_id", "full")


@query("proj_du_dedupe_last", """WITH x AS (SELECT l_orderkey AS du_name, l_linenumber, l_partkey AS p, l_quantity FROM lineitem) SELECT du_name, max_by(l_quantity, row(l_linenumber, p, l_quantity)) AS quantity FROM x GROUP BY du_name""")
def du_dedupe_last(spark: SparkSession, d: str) -> DataFrame:
    """Repeated names: the later row wins."""
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("du_name")).agg(F.max_by("l_quantity", F.struct("l_linenumber", "l_partkey", "l_quantity")).alias("quantity"))


@query("win_first_last_per_day_du", with_views("""r AS (SELECT visit_id, flw_id, visit_day, case_id, ROW_NUMBER() OVER (PARTITION BY flw_id, visit_day, case_id ORDER BY visit_date, visit_id) AS a, ROW_NUMBER() OVER (PARTITION BY flw_id, visit_day, case_id ORDER BY visit_date DESC, visit_id DESC) AS b FROM visits)
SELECT visit_id, a = 1 AS is_first, b = 1 AS is_last FROM r"""))
def first_last_per_day(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("flw_id", "visit_day", "case_id")
    a, b = F.row_number().over(w.orderBy("visit_date", "visit_id")), F.row_number().over(w.orderBy(F.desc("visit_date"), F.desc("visit_id")))
    return visits(spark, d).select("visit_id", (a == 1).alias("is_first"), (b == 1).alias("is_last"))


@query("aggr_client_area_stats", with_views("SELECT service_area_id, COUNT(*) AS dus, COUNT(*) FILTER (WHERE status = 'completed') AS completed, CAST(SUM(buildings) AS BIGINT) AS buildings, ROUND(SUM(surface_area), 4) AS area, CAST(SUM(delivery_count) AS BIGINT) AS deliveries, COUNT(DISTINCT flw_id) AS flws, ROUND(100.0::DOUBLE * COUNT(*) FILTER (WHERE status = 'completed') / COUNT(*), 1) AS completion_pct FROM dus GROUP BY service_area_id"))
def client_area_stats(spark: SparkSession, d: str) -> DataFrame:
    return delivery_units(spark, d).groupBy("service_area_id").agg(
        F.count("*").alias("dus"), F.count_if(F.col("status") == "completed").alias("completed"), F.sum("buildings").alias("buildings"), F.round(F.sum("surface_area"), 4).alias("area"), F.sum("delivery_count").alias("deliveries"), F.count_distinct("flw_id").alias("flws"),
        F.round(100.0 * F.count_if(F.col("status") == "completed") / F.count("*"), 1).alias("completion_pct"),
    )
