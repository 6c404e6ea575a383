"""Projections, filters, cleaning and scalar functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visitlens.functions.columns import right_closed_bin
from visitlens.functions.resolve import containing, standardised
from visitlens.registry import query
from visitlens.sources.views import cells, delivery_units, table, visits, with_views


@query("proj_detect_columns", "SELECT * FROM (VALUES ('id', 'visit_id'), ('date', 'visit_date'), ('lat', 'latitude'), ('lon', 'longitude')) t(role, found)")
def detect_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns found by what their names contain."""
    columns = visits(spark, d).columns
    roles = {"id": ["visit_id", "id"], "date": ["visit_date", "date"], "lat": ["lattitude", "latitude", "lat"], "lon": ["longitude", "lon"]}
    return spark.createDataFrame([(r, containing(columns, p)) for r, p in roles.items()], "role string, found string")


@query("proj_standardise_columns", "SELECT event_id AS visit_id, user_id AS flw_id, ts AS visit_date FROM events")
def standardise_columns(spark: SparkSession, d: str) -> DataFrame:
    renamed = standardised(table(spark, d, "events"), {"visit_id": ["visit id", "event_id"], "flw_id": ["worker", "user_id"], "visit_date": ["ts", "date"]})
    return renamed.select("visit_id", "flw_id", "visit_date")


@query("proj_date_sniffing", "SELECT ROUND(AVG(CASE WHEN TRY_CAST(x AS DATE) IS NOT NULL THEN 1.0 ELSE 0.0 END), 4) AS date_share, AVG(CASE WHEN TRY_CAST(x AS DATE) IS NOT NULL THEN 1.0 ELSE 0.0 END) >= 0.8 AS is_date FROM (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS x FROM events ORDER BY event_id LIMIT 10)")
def date_sniffing(spark: SparkSession, d: str) -> DataFrame:
    """Whether the first ten values of a text column are dates."""
    ten = table(spark, d, "events").orderBy("event_id").limit(10).select(F.col("ts").cast("date").cast("string").alias("x"))
    parsed = F.avg(F.when(F.expr("try_cast(x AS DATE)").isNotNull(), 1.0).otherwise(0.0))
    return ten.agg(F.round(parsed, 4).alias("date_share"), (parsed >= 0.8).alias("is_date"))


@query("proj_coordinate_filter", with_views("SELECT visit_id, latitude, longitude FROM visits WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND k IS NOT NULL"))
def coordinate_filter(spark: SparkSession, d: str) -> DataFrame:
    return visits(spark, d).where(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180) & F.col("k").isNotNull()).select("visit_id", "latitude", "longitude")


@query("proj_date_filter", with_views("SELECT visit_id, visit_day FROM visits WHERE visit_date IS NOT NULL AND visit_day BETWEEN (SELECT MIN(visit_day) FROM visits) + 5 AND (SELECT MIN(visit_day) FROM visits) + 15 AND event_type IN ('view', 'click', 'purchase')"))
def date_filter(spark: SparkSession, d: str) -> DataFrame:
    """Days of an inclusive range, of some types only."""
    v = visits(spark, d)
    first = F.broadcast(v.agg(F.min("visit_day").alias("d0")))
    return v.join(first).where(F.col("visit_day").between(F.date_add("d0", 5), F.date_add("d0", 15)) & F.col("event_type").isin("view", "click", "purchase")).select("visit_id", "visit_day")


@query("proj_approved_only", with_views("SELECT visit_id, flw_id, visit_day FROM visits WHERE lower(status) = 'approved'"))
def approved_only(spark: SparkSession, d: str) -> DataFrame:
    return visits(spark, d).where(F.lower("status") == "approved").select("visit_id", "flw_id", "visit_day")


@query("proj_du_cleaning", with_views("SELECT du_name, NULLIF(CASE WHEN buildings = 0 THEN '---' ELSE status END, '---') AS status, COALESCE(service_area_id, 0) || '-' || (du_name % 7) AS area_key FROM dus WHERE service_area_id IS NOT NULL"))
def du_cleaning(spark: SparkSession, d: str) -> DataFrame:
    """A dash mark becomes null; the area's key is two whole numbers."""
    marked = delivery_units(spark, d).withColumn("status", F.when(F.col("buildings") == 0, "---").otherwise(F.col("status")))
    key = F.concat_ws("-", F.coalesce("service_area_id", F.lit(0)).cast("string"), (F.col("du_name") % 7).cast("string"))
    return marked.replace({"---": None}, subset=["status"]).where("service_area_id IS NOT NULL").select("du_name", "status", key.alias("area_key"))


@query("proj_split_flws", with_views("""f AS (SELECT visit_id, flw_id % 60 AS w, opportunity_id AS opp, MIN(visit_id) OVER (PARTITION BY flw_id % 60, opportunity_id) AS first, COUNT(*) OVER () AS c FROM visits), n AS (SELECT w, COUNT(DISTINCT opp) AS k FROM f GROUP BY w)
SELECT visit_id, CASE WHEN k > 1 THEN w || '_' || DENSE_RANK() OVER (PARTITION BY w ORDER BY first) ELSE CAST(w AS VARCHAR) END AS flw FROM f JOIN n USING (w)"""))
def split_flws(spark: SparkSession, d: str) -> DataFrame:
    """Workers of several opportunities are told apart by a suffix, numbered by first appearance."""
    v = visits(spark, d).select("visit_id", (F.col("flw_id") % 60).alias("w"), F.col("opportunity_id").alias("opp"))
    order = v.groupBy("w", "opp").agg(F.min("visit_id").alias("first"))
    named = order.select("w", "opp", F.row_number().over(Window.partitionBy("w").orderBy("first")).alias("i"), F.count("*").over(Window.partitionBy("w")).alias("k"))
    text = F.col("w").cast("string")
    return v.join(named, ["w", "opp"]).select("visit_id", F.when(F.col("k") > 1, F.concat(text, F.lit("_"), "i")).otherwise(text).alias("flw"))


@query("proj_json_flatten", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS props_k FROM events")
def json_flatten(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k INT").alias("p")).select("event_id", F.col("p.k").alias("props_k"))


@query("udtf_json_entries", "SELECT event_id, e.key AS key, CAST(e.value AS VARCHAR) AS value FROM events, json_each(props) e")
def json_entries(spark: SparkSession, d: str) -> DataFrame:
    """A JSON object as one row for each key."""
    return table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string, string>")).alias("key", "value"))


@query("proj_gps_split", with_views("SELECT visit_id, ROUND(latitude, 3) AS lat, ROUND(longitude, 3) AS lon, CAST(k AS DOUBLE) AS altitude, 5.0::DOUBLE AS accuracy FROM visits"))
def gps_split(spark: SparkSession, d: str) -> DataFrame:
    """Four numbers in one text: latitude, longitude, altitude, accuracy."""
    text = visits(spark, d).select("visit_id", F.concat_ws(" ", F.round("latitude", 3).cast("string"), F.round("longitude", 3).cast("string"), F.col("k").cast("string"), F.lit("5.0")).alias("gps"))
    part = lambda i: F.expr(f"try_cast(split_part(gps, ' ', {i}) AS DOUBLE)")
    return text.select("visit_id", part(1).alias("lat"), part(2).alias("lon"), part(3).alias("altitude"), part(4).alias("accuracy"))


@query("proj_defaults", with_views("SELECT du_name, COALESCE(lower(NULLIF(status, 'visited')), 'unvisited') AS status, COALESCE(delivery_count, 0) AS delivery_count FROM dus"))
def defaults(spark: SparkSession, d: str) -> DataFrame:
    return delivery_units(spark, d).select("du_name", F.coalesce(F.lower(F.nullif(F.col("status"), F.lit("visited"))), F.lit("unvisited")).alias("status"), F.coalesce("delivery_count", F.lit(0)).alias("delivery_count"))


@query("proj_form_flatten", "SELECT conv_id, turn, role, length(text) AS n_chars FROM conversations")
def form_flatten(spark: SparkSession, d: str) -> DataFrame:
    """Nested records with typed fields, flattened again."""
    nested = table(spark, d, "conversations").select(F.struct(F.struct("conv_id", "turn").alias("meta"), F.struct("role", "text").alias("form")).alias("r"))
    return nested.select("r.meta.conv_id", "r.meta.turn", "r.form.role", F.length("r.form.text").alias("n_chars"))


@query("proj_column_order", with_views("SELECT flw_id, visit_id, age_months, gender, k FROM visits"))
def column_order(spark: SparkSession, d: str) -> DataFrame:
    """Fixed columns first, the others by name."""
    v = visits(spark, d).select("visit_id", "k", "gender", "flw_id", "age_months")
    fixed = ["flw_id", "visit_id"]
    return v.select(*fixed, *sorted(c for c in v.columns if c not in fixed))


@query("proj_display", with_views("SELECT du_name AS unit, initcap_status AS status, printf('%,d', buildings) AS buildings FROM (SELECT du_name, upper(status[1]) || status[2:] AS initcap_status, buildings FROM dus)"))
def display(spark: SparkSession, d: str) -> DataFrame:
    return delivery_units(spark, d).select(F.col("du_name").alias("unit"), F.initcap("status").alias("status"), F.format_number("buildings", 0).alias("buildings"))


@query("proj_wildcard_filter", with_views("SELECT du_name FROM dus WHERE service_area_id IN (1, 2, 3) AND status = 'completed'"))
def wildcard_filter(spark: SparkSession, d: str) -> DataFrame:
    return chosen(delivery_units(spark, d), service_area_id=[1, 2, 3], status=["completed"], flw_id="all").select("du_name")


def chosen(df: DataFrame, **wanted: object) -> DataFrame:
    """Rows whose columns have one of the wanted values; "all" takes every value."""
    for c, values in wanted.items():
        if values != "all":
            df = df.where(F.col(c).isin(list(values)))
    return df


@query("proj_one_day", with_views("SELECT visit_id FROM visits WHERE visit_day = (SELECT MIN(visit_day) FROM visits) + 3"))
def one_day(spark: SparkSession, d: str) -> DataFrame:
    v = visits(spark, d)
    return v.join(F.broadcast(v.agg(F.date_add(F.min("visit_day"), 3).alias("visit_day"))), "visit_day").select("visit_id")


@query("proj_area_drilldown", with_views("SELECT du_name, status, buildings FROM dus WHERE service_area_id = 7"))
def area_drilldown(spark: SparkSession, d: str) -> DataFrame:
    return delivery_units(spark, d).where("service_area_id = 7").select("du_name", "status", "buildings")


@query("proj_blank_normalise", with_views("SELECT visit_id, COALESCE(NULLIF(TRIM(unwell), ''), '.') AS unwell, COALESCE(CASE WHEN isinf(value / NULLIF(k - 50, 0)) THEN NULL ELSE ROUND(value / NULLIF(k - 50, 0), 6) END, 0) AS per_k FROM visits"))
def blank_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Blank text becomes a point, what can't be divided zero."""
    return visits(spark, d).select("visit_id", F.coalesce(F.nullif(F.trim("unwell"), F.lit("")), F.lit(".")).alias("unwell"), F.coalesce(F.round(F.try_divide("value", F.col("k") - 50), 6), F.lit(0.0)).alias("per_k"))


@query("proj_blank_category", with_views("SELECT visit_id, COALESCE(gender, '__BLANK__') AS gender FROM visits"))
def blank_category(spark: SparkSession, d: str) -> DataFrame:
    return visits(spark, d).select("visit_id", F.coalesce("gender", F.lit("__BLANK__")).alias("gender"))


@query("proj_min_visits", with_views("SELECT flw_id, COUNT(*) AS n FROM visits GROUP BY flw_id HAVING COUNT(*) >= 65"))
def min_visits(spark: SparkSession, d: str) -> DataFrame:
    return visits(spark, d).groupBy("flw_id").agg(F.count("*").alias("n")).where("n >= 65")


@query("proj_microplan_key", with_views("SELECT du_name, 'OA' || service_area_id || '-' || du_name AS service_area_key FROM dus"))
def microplan_key(spark: SparkSession, d: str) -> DataFrame:
    return delivery_units(spark, d).select("du_name", F.concat(F.lit("OA"), "service_area_id", F.lit("-"), "du_name").alias("service_area_key"))


@query("proj_engine_columns", with_views("SELECT visit_id, unwell AS diligence_unwell, gender AS diligence_gender, latitude, longitude FROM visits"))
def engine_columns(spark: SparkSession, d: str) -> DataFrame:
    return visits(spark, d).withColumnsRenamed({"unwell": "diligence_unwell", "gender": "diligence_gender"}).select("visit_id", F.col("diligence_unwell"), F.col("diligence_gender"), "latitude", "longitude")


@query("proj_join_column_cleanup", with_views("SELECT du_name, status, event_status FROM (SELECT d.du_name, d.status, v.status AS event_status FROM dus d JOIN visits v ON v.visit_id = d.du_name)"))
def join_column_cleanup(spark: SparkSession, d: str) -> DataFrame:
    """Columns that both sides have are named before the join."""
    v = visits(spark, d).select(F.col("visit_id").alias("du_name"), F.col("status").alias("event_status"))
    return delivery_units(spark, d).select("du_name", "status").join(v, "du_name")


@query("scal_string_clean", "SELECT p_partkey, lower(regexp_replace(p_name, '[^A-Za-z0-9_-]', '', 'g')) AS clean, split_part(p_name, ' ', 1) AS first_word, replace(p_type, '_pct', '') AS kind FROM part")
def string_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.lower(F.regexp_replace("p_name", "[^A-Za-z0-9_-]", "")).alias("clean"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("first_word"), F.replace("p_type", F.lit("_pct"), F.lit("")).alias("kind"))


@query("scal_regex_extract", "SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '([0-9]+)', 1) AS digits FROM pages")
def regex_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", "([0-9]+)", 1).alias("digits"))


@query("scal_json_extract", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("scal_split_like_cast", "SELECT c_custkey, split_part(c_name, '#', 2) AS number, c_name LIKE '%00%' AS has_00, CAST(CASE WHEN c_acctbal < 0 THEN -floor(-c_acctbal + 0.5) ELSE floor(c_acctbal + 0.5) END AS BIGINT) AS balance FROM customer")
def split_like_cast(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.split_part("c_name", F.lit("#"), F.lit(2)).alias("number"), F.col("c_name").like("%00%").alias("has_00"), F.round("c_acctbal").cast("bigint").alias("balance"))


@query("scal_contains_strip", "SELECT doc_id, contains(lower(text), 'license') AS mentions_license, length(trim(text)) AS n FROM documents")
def contains_strip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.contains(F.lower("text"), F.lit("license")).alias("mentions_license"), F.length(F.trim("text")).cast("bigint").alias("n"))


@query("scal_periods", with_views("SELECT visit_id, CAST(date_trunc('month', visit_day) AS DATE) AS month, CAST(date_trunc('quarter', visit_day) AS DATE) AS quarter, CAST(date_trunc('week', visit_day) AS DATE) AS week FROM visits"))
def periods(spark: SparkSession, d: str) -> DataFrame:
    return visits(spark, d).select("visit_id", *(F.trunc("visit_day", p).alias(p) for p in ("month", "quarter", "week")))


@query("scal_date_spine", with_views("SELECT CAST(UNNEST(generate_series(MIN(visit_day), MAX(visit_day), INTERVAL 1 DAY)) AS DATE) AS day FROM visits"))
def date_spine(spark: SparkSession, d: str) -> DataFrame:
    return visits(spark, d).agg(F.sequence(F.min("visit_day"), F.max("visit_day")).alias("s")).select(F.explode("s").alias("day"))


@query("scal_parse_datetimes", "SELECT event_id, ts AS parsed FROM events")
def parse_datetimes(spark: SparkSession, d: str) -> DataFrame:
    """Tolerant parsing: the first of several formats that fits."""
    text = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).otherwise(F.date_format(F.col("ts").cast("timestamp"), "dd/MM/yyyy HH.mm.ss.SSSSSS")).alias("x"))
    tries = [F.try_to_timestamp("x", F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss.SSSSSS", "dd/MM/yyyy HH.mm.ss.SSSSSS")]
    return text.select("event_id", F.coalesce(*tries).cast("timestamp_ntz").alias("parsed"))


@query("scal_bround", "SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_quantity / 2.0, 0) AS half FROM lineitem")
def bround(spark: SparkSession, d: str) -> DataFrame:
    """Rounding halves to even numbers."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.bround(F.col("l_quantity") / 2.0, 0).alias("half"))


@query("scal_cut", with_views("SELECT visit_id, CAST(GREATEST(CEIL(age_months / 5.0) - 1, 0) AS INT) AS bin, CASE WHEN age_months < 12 THEN 'infant' WHEN age_months < 36 THEN 'toddler' ELSE 'child' END AS stage FROM visits"))
def cut(spark: SparkSession, d: str) -> DataFrame:
    stage = F.when(F.col("age_months") < 12, "infant").when(F.col("age_months") < 36, "toddler").otherwise("child")
    return visits(spark, d).select("visit_id", right_closed_bin("age_months", 0, 5.0).alias("bin"), stage.alias("stage"))


@query("scal_lookup_map", with_views("SELECT visit_id, CASE status WHEN 'approved' THEN '#2ca02c' WHEN 'rejected' THEN '#d62728' ELSE '#7f7f7f' END AS colour FROM visits"))
def lookup_map(spark: SparkSession, d: str) -> DataFrame:
    colours = F.create_map(*map(F.lit, ("approved", "#2ca02c", "rejected", "#d62728")))
    return visits(spark, d).select("visit_id", F.coalesce(F.try_element_at(colours, F.col("status")), F.lit("#7f7f7f")).alias("colour"))


@query("scal_breadcrumb", "SELECT n_nationkey, r_name || ' > ' || n_name AS path, starts_with(n_name, 'NATION_1') AS in_group FROM nation JOIN region ON n_regionkey = r_regionkey")
def breadcrumb(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), F.broadcast(table(spark, d, "region"))
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", F.concat_ws(" > ", "r_name", "n_name").alias("path"), F.startswith("n_name", F.lit("NATION_1")).alias("in_group"))


@query("scal_array_ops", "WITH x AS (SELECT c_nationkey, UNNEST(string_split(lower(c_mktsegment) || ';' || CAST(c_custkey % 3 AS VARCHAR), ';')) AS p FROM customer) SELECT c_nationkey, string_agg(DISTINCT p, ';' ORDER BY p) AS parts FROM x GROUP BY c_nationkey")
def array_ops(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lower("c_mktsegment"), F.lit(";"), (F.col("c_custkey") % 3).cast("string"))
    parts = table(spark, d, "customer").select("c_nationkey", F.explode(F.split(text, ";")).alias("p")).groupBy("c_nationkey").agg(F.collect_set("p").alias("s"))
    return parts.select("c_nationkey", F.array_join(F.array_sort("s"), ";").alias("parts"))


@query("scal_nested_map", with_views("SELECT flw_id, status, COUNT(*) AS n FROM visits GROUP BY ALL"))
def nested_map(spark: SparkSession, d: str) -> DataFrame:
    """Counts by worker as a map of statuses, and back to rows."""
    counts = visits(spark, d).groupBy("flw_id", "status").agg(F.count("*").alias("n"))
    maps = counts.groupBy("flw_id").agg(F.map_from_entries(F.collect_list(F.struct("status", "n"))).alias("m"))
    return maps.select("flw_id", F.explode("m").alias("status", "n"))


@query("scal_case_ladder", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 9 END AS urgency FROM orders")
def case_ladder(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", F.when(p == "1-URGENT", 1).when(p == "2-HIGH", 2).otherwise(9).alias("urgency"))


@query("scal_naive_timestamps", "SELECT event_id, ts AS at_utc, date_part('hour', ts) AS hour FROM events")
def naive_timestamps(spark: SparkSession, d: str) -> DataFrame:
    """Zoned times in UTC, then without a zone."""
    zoned = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("t"))
    return zoned.select("event_id", F.col("t").cast("timestamp_ntz").alias("at_utc"), F.hour("t").cast("bigint").alias("hour"))


@query("aggr_visit_timing", with_views("t AS (SELECT flw_id, visit_date, LEAD(visit_date) OVER (PARTITION BY flw_id, visit_day ORDER BY visit_date, visit_id) AS e FROM visits) SELECT flw_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE e IS NULL) AS without_end, ROUND(AVG(date_diff('second', visit_date, e)), 3) AS mean_seconds FROM (SELECT flw_id, date_trunc('second', visit_date) AS visit_date, date_trunc('second', e) AS e FROM t) GROUP BY flw_id"))
def visit_timing(spark: SparkSession, d: str) -> DataFrame:
    """Start and end as clock texts: parsed, checked, and their seconds averaged."""
    w = Window.partitionBy("flw_id", "visit_day").orderBy("visit_date", "visit_id")
    clock = lambda c: F.date_format(c.cast("timestamp"), "HH:mm:ss")
    t = visits(spark, d).select("flw_id", clock(F.col("visit_date")).alias("s"), clock(F.lead("visit_date").over(w)).alias("e"))
    seconds = lambda c: F.hour(F.try_to_timestamp(c, F.lit("HH:mm:ss"))) * 3600 + F.minute(F.try_to_timestamp(c, F.lit("HH:mm:ss"))) * 60 + F.second(F.try_to_timestamp(c, F.lit("HH:mm:ss")))
    return t.groupBy("flw_id").agg(F.count("*").alias("n"), F.count_if(F.col("e").isNull()).alias("without_end"), F.round(F.avg(seconds("e") - seconds("s")), 3).alias("mean_seconds"))


_KM2 = 2.0 * 2.0


@query("aggr_density_by_ward_pivot", with_views(f"""k AS (SELECT ward_id, population / {_KM2}::DOUBLE AS density FROM cells)
SELECT ward_id, COUNT(*) FILTER (WHERE density < 10) AS Low, COUNT(*) FILTER (WHERE density >= 10 AND density < 50) AS Medium, COUNT(*) FILTER (WHERE density >= 50) AS High
FROM k GROUP BY ward_id"""))
def density_by_ward_pivot(spark: SparkSession, d: str) -> DataFrame:
    """A ward's cells by class of people per square kilometre, for cells of two kilometres."""
    density = F.col("population") / _KM2
    kind = F.when(density < 10, "Low").when(density < 50, "Medium").otherwise("High")
    return cells(spark, d).withColumn("kind", kind).groupBy("ward_id").pivot("kind", ["Low", "Medium", "High"]).count().fillna(0)


def token_sort_ratio(a: str, b: str) -> float:
    """Similarity of two names in per cent: words sorted, then 2 × longest common subsequence over both lengths."""
    a, b = (" ".join(sorted(x.lower().split())) for x in (a, b))
    if not a or not b:
        return 0.0
    row = np.zeros(len(b) + 1, np.int64)
    codes = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    for c in a:
        hit = np.append(0, row[:-1] + (codes == ord(c)))
        row = np.maximum.accumulate(np.maximum(row, hit))
    return 200.0 * int(row[-1]) / (len(a) + len(b))


def token_sort_ratios(a: list[str], b: list[str], most: int = 1 << 20) -> np.ndarray:
    """The same of many pairs. Pairs of like lengths are compared together, `most` characters or one pair at a time."""
    plain = {x: np.frombuffer(" ".join(sorted(x.lower().split())).encode("utf-32-le"), np.int32) for x in {*a, *b}}
    a, b = [plain[x] for x in a], [plain[x] for x in b]
    n, m = (np.array([len(x) for x in side], np.int64) for side in (a, b))
    out, order, at = np.zeros(len(a)), np.lexsort((n, m)), 0
    order = order[(n > 0)[order] & (m > 0)[order]]
    widest = np.maximum.accumulate(np.maximum(n, m)[order])

    def padded(side: list[np.ndarray], lengths: np.ndarray, rows: np.ndarray, blank: int) -> np.ndarray:
        codes = np.full((len(rows), int(lengths[rows].max())), blank, np.int32)
        codes[np.arange(codes.shape[1]) < lengths[rows, None]] = np.concatenate([side[i] for i in rows])
        return codes

    while at < len(order):
        stop = at + max(1, int(np.count_nonzero(widest[at:] * np.arange(1, len(order) - at + 1) <= most)))
        rows, at = order[at:stop], stop
        x, y = padded(a, n, rows, -1), padded(b, m, rows, -2)
        row = np.zeros((len(rows), y.shape[1] + 1), np.int32)
        for k in range(x.shape[1]):
            row[:, 1:] = np.maximum(row[:, 1:], row[:, :-1] + (y == x[:, k, None]))
            np.maximum.accumulate(row, axis=1, out=row)
        out[rows] = 200.0 * row[:, -1] / (n[rows] + m[rows])
    return out
