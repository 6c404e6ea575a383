"""Readers and writers: files of several formats and layouts, nested targets, tables that are written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.registry import query
from visitlens.sources.storage import scratch
from visitlens.sources.views import delivery_units, table, visits, with_views


@query("src_csv_round_trip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Written as CSV with a header, read with a schema of its own."""
    path = scratch(spark, "csv")
    table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal").write.csv(path, header=True)
    return spark.read.csv(path, header=True, schema="c_custkey bigint, c_name string, c_nationkey int, c_acctbal double")


@query("src_csv_bad_numbers", "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE c_nationkey END AS buildings FROM customer")
def csv_bad_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers that can't be read become zero."""
    path = scratch(spark, "bad-csv")
    text = F.when(F.col("c_custkey") % 7 == 0, "n/a").otherwise(F.col("c_nationkey").cast("string"))
    table(spark, d, "customer").select("c_custkey", text.alias("buildings")).write.csv(path, header=True)
    raw = spark.read.csv(path, header=True, schema="c_custkey bigint, buildings string")
    return raw.select("c_custkey", F.coalesce(F.expr("try_cast(buildings AS INT)"), F.lit(0)).alias("buildings"))


@query("src_csv_label_from_name", "SELECT CASE WHEN c_custkey % 2 = 0 THEN 'real' ELSE 'fake' END AS classification, COUNT(*) AS n FROM customer GROUP BY 1")
def csv_label_from_name(spark: SparkSession, d: str) -> DataFrame:
    """Rows labelled by the folder or file they come from."""
    path = scratch(spark, "labelled")
    kind = F.when(F.col("c_custkey") % 2 == 0, "real").otherwise("fake")
    table(spark, d, "customer").select("c_custkey", "c_name", kind.alias("kind")).write.partitionBy("kind").csv(path, header=True)
    rows = spark.read.option("recursiveFileLookup", "true").csv(path, header=True, schema="c_custkey bigint, c_name string").select("*", "_metadata.file_path")
    return rows.groupBy(F.when(F.contains("file_path", F.lit("kind=real")), "real").otherwise("fake").alias("classification")).agg(F.count("*").alias("n"))


@query("src_json_round_trip", "SELECT conv_id, turn, role, text FROM conversations")
def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "json")
    t = table(spark, d, "conversations")
    t.write.json(path)
    return spark.read.json(path, schema="conv_id bigint, turn bigint, role string, text string")


@query("src_orc_round_trip", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def orc_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "orc")
    table(spark, d, "supplier").write.orc(path)
    return spark.read.orc(path)


@query("src_partitioned_sink", with_views("SELECT opportunity_id, COUNT(*) AS n, COUNT(DISTINCT flw_id) AS flws FROM visits WHERE opportunity_id IN (1, 3) GROUP BY opportunity_id"))
def partitioned_sink(spark: SparkSession, d: str) -> DataFrame:
    """One folder per opportunity instead of one frame each; a filter on it reads only its folders."""
    path = scratch(spark, "by-opportunity")
    visits(spark, d).select("opportunity_id", "visit_id", "flw_id").write.partitionBy("opportunity_id").parquet(path)
    return spark.read.parquet(path).where("opportunity_id IN (1, 3)").groupBy(F.col("opportunity_id").cast("bigint").alias("opportunity_id")).agg(F.count("*").alias("n"), F.count_distinct("flw_id").alias("flws"))


@query("src_bucketed_join", "SELECT o_orderkey, COUNT(*) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def bucketed_join(spark: SparkSession, d: str) -> DataFrame:
    """Two tables bucketed on the join key meet without a shuffle."""
    name = f"bucketed_{uuid.uuid4().hex}"
    for t, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        table(spark, d, t).write.bucketBy(8, key).sortBy(key).option("path", scratch(spark, t)).saveAsTable(f"{name}_{t}")
    o, li = spark.table(f"{name}_orders"), spark.table(f"{name}_lineitem")
    for t in ("orders", "lineitem"):
        spark.sql(f"DROP TABLE {name}_{t}")  # the catalogue forgets them; their files stay under the shared folder
    return o.join(li, o.o_orderkey == li.l_orderkey).groupBy("o_orderkey").agg(F.count("*").alias("lines"))


@query("src_named_query", "SELECT n_name, COUNT(*) AS customers FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def named_query(spark: SparkSession, d: str) -> DataFrame:
    """A query kept by name, run over views that are passed to it."""
    saved = {"customers_by_nation": "SELECT n_name, COUNT(*) AS customers FROM {nation} JOIN {customer} ON c_nationkey = n_nationkey GROUP BY n_name"}
    return spark.sql(saved["customers_by_nation"], nation=table(spark, d, "nation"), customer=table(spark, d, "customer"))


@query("src_paged_scan", "SELECT event_id // 1000 AS page, COUNT(*) AS n, MIN(event_id) AS first_id, MAX(event_id) AS last_id FROM events GROUP BY 1")
def paged_scan(spark: SparkSession, d: str) -> DataFrame:
    """Pages by ranges of a key, which are stable whatever the order of reading."""
    e = table(spark, d, "events")
    return e.groupBy(F.expr("event_id div 1000").alias("page")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("src_nested_targets", "SELECT r_name AS domain, n_name AS ward, n_nationkey * 10 AS visit_target FROM nation JOIN region ON r_regionkey = n_regionkey")
def nested_targets(spark: SparkSession, d: str) -> DataFrame:
    """Targets kept as nested JSON maps (domain, ward, numbers), exploded to rows."""
    n, r = table(spark, d, "nation"), F.broadcast(table(spark, d, "region"))
    rows = n.join(r, n.n_regionkey == r.r_regionkey)
    kept = rows.groupBy("r_name").agg(F.map_from_entries(F.collect_list(F.struct("n_name", F.struct((F.col("n_nationkey") * 10).alias("visit_target"))))).alias("wards"))
    text = kept.select(F.to_json(F.create_map("r_name", "wards")).alias("j"))
    maps = text.select(F.explode(F.from_json("j", "map<string, map<string, struct<visit_target: int>>>")).alias("domain", "wards"))
    return maps.select("domain", F.explode("wards").alias("ward", "t")).select("domain", "ward", "t.visit_target")


@query("src_latest_per_form", "SELECT conv_id, arg_max(role, turn) AS last_role, MAX(turn) AS last_turn FROM conversations GROUP BY conv_id")
def latest_per_form(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max_by("role", "turn").alias("last_role"), F.max("turn").alias("last_turn"))


@query("src_skip_report", with_views("SELECT COUNT(*) FILTER (WHERE d.du_name IS NOT NULL) AS matched, COUNT(*) FILTER (WHERE d.du_name IS NULL) AS skipped FROM visits v LEFT JOIN dus d ON d.du_name = v.visit_id"))
def skip_report(spark: SparkSession, d: str) -> DataFrame:
    v, u = visits(spark, d), delivery_units(spark, d)
    return v.join(u, v.visit_id == u.du_name, "left").agg(F.count("du_name").alias("matched"), F.count_if(F.col("du_name").isNull()).alias("skipped"))


@query("src_geojson_sink", with_views("SELECT ward_id, COUNT(*) AS features FROM cells GROUP BY ward_id"))
def geojson_sink(spark: SparkSession, d: str) -> DataFrame:
    """Cells as GeoJSON lines, written as text and read back."""
    from visitlens.sources.views import cells

    path = scratch(spark, "geojson")
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col("col") + 0.5, F.col("row") + 0.5).alias("coordinates"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("ward_id", "population").alias("properties"), point.alias("geometry")))
    cells(spark, d).select(feature.alias("value")).write.text(path)
    back = spark.read.json(path, schema="type string, properties struct<ward_id: string, population: double>, geometry struct<type: string, coordinates: array<double>>")
    return back.groupBy("properties.ward_id").agg(F.count("*").alias("features"))
