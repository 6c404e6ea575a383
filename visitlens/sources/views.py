"""The canonical views: visits, delivery units and grid cells, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per visit of a worker (flw)."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.when(F.col("event_type") == "purchase", "approved").when(F.col("event_type") == "error", "rejected").otherwise("pending")
    return e.select(
        F.col("event_id").alias("visit_id"),
        F.col("user_id").alias("flw_id"),
        F.concat(F.lit("worker_"), F.col("user_id")).alias("flw_name"),
        (F.col("user_id") % 5).alias("opportunity_id"),
        F.concat(F.lit("opp_"), F.col("user_id") % 5).alias("opportunity_name"),
        F.col("ts").alias("visit_date"),
        F.col("ts").cast("date").alias("visit_day"),
        status.alias("status"),
        "event_type",
        "value",
        "props",
        k.alias("k"),
        ((F.col("event_id") * 7) % 60).alias("age_months"),
        F.when(F.col("event_id") % 11 == 0, None).when(F.col("event_id") % 2 == 0, "female_child").otherwise("male_child").alias("gender"),
        F.when(F.col("event_id") % 13 == 0, "").when((F.col("event_id") + F.col("user_id")) % 5 == 0, "yes").otherwise("no").alias("unwell"),
        (9.5 + ((F.col("event_id") * 37 + F.col("user_id")) % 120).cast("double") / 10.0).alias("muac_cm"),
        (F.col("user_id") * 100 + F.col("event_id") % 40).alias("case_id"),
        (9.0 + k.cast("double") / 1000.0).alias("latitude"),
        (7.0 + (F.col("event_id") % 100).cast("double") / 1000.0).alias("longitude"),
    )


#: Questions of the survey form that are answered with yes or no, or left blank.
QUESTIONS = ("glasses", "diarrhea", "diagnosed", "recent_dose", "dose_before", "any_vaccine", "treated")
DILIGENCE = tuple(f"diligence_{i}" for i in range(1, 16))


def _answer(i: int) -> str:
    x = f"(visit_id * {2 * i + 3} + flw_id * {i + 1})"
    return f"CASE WHEN {x} % {4 + 3 * i} = 0 THEN '' WHEN {x} % (3 + flw_id % 4) = 0 THEN 'yes' ELSE 'no' END AS {QUESTIONS[i]}"


_ANSWERS = (
    *(_answer(i) for i in range(len(QUESTIONS))),
    "CASE WHEN visit_id % 17 = 0 THEN '' WHEN muac_cm < 9.5 + flw_id % 4 THEN 'Red' WHEN muac_cm < 11.5 + flw_id % 3 THEN 'Yellow' ELSE 'Green' END AS muac_colour",
    "CASE WHEN visit_id % 23 = 0 THEN '' WHEN visit_id * 7 % (3 + flw_id % 6) = 0 THEN 'true' ELSE 'false' END AS all_no",
    "CASE WHEN flw_id % 3 = 0 THEN muac_cm ELSE 9.5 + ((visit_id * 37 + flw_id) % 60 + (visit_id * 53 + 7 * flw_id) % 60) / 10.0 END AS measured_cm",
    *(f"CASE WHEN visit_id % 19 = 0 THEN NULL ELSE CAST(visit_id * {j + 2} % (1 + (flw_id + {j}) % 3) AS VARCHAR(9)) END AS {name}" for j, name in enumerate(DILIGENCE)),
)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits with the answers to the survey form."""
    typed = [a.replace("9.5", "9.5D").replace("10.0", "10.0D").replace("11.5", "11.5D").replace("VARCHAR(9)", "STRING") for a in _ANSWERS]
    return visits(spark, sf_dir).selectExpr("*", *typed)


def delivery_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per delivery unit (du) of a service area."""
    o, c, li = (table(spark, sf_dir, x) for x in ("orders", "customer", "lineitem"))
    lines = li.groupBy("l_orderkey").agg(F.count("*").alias("buildings"), F.sum("l_quantity").alias("quantity"), F.max("l_shipdate").alias("checked_out_date"))
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "visited").otherwise("unvisited")
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(lines, o.o_orderkey == lines.l_orderkey, "left")
        .select(
            F.col("o_orderkey").alias("du_name"),
            F.col("c_nationkey").alias("service_area_id"),
            F.col("o_custkey").alias("flw_id"),
            status.alias("status"),
            F.coalesce("buildings", F.lit(0)).alias("buildings"),
            F.coalesce("quantity", F.lit(0)).cast("bigint").alias("delivery_count"),
            F.col("o_totalprice").alias("surface_area"),
            F.col("o_orderdate").alias("checked_in_date"),
            "checked_out_date",
        )
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A population grid: cells by row and column, with their ward."""
    return table(spark, sf_dir, "part").select(
        F.expr("CAST(p_partkey AS BIGINT) div 50").alias("row"),
        (F.col("p_partkey") % 50).alias("col"),
        F.col("p_size").cast("double").alias("population"),
        F.col("p_brand").alias("ward_id"),
    )


#: The same views for the SQL that results are held against.
VISITS_SQL = """visits AS (SELECT event_id AS visit_id, user_id AS flw_id, concat('worker_', user_id) AS flw_name,
 user_id % 5 AS opportunity_id, concat('opp_', user_id % 5) AS opportunity_name, ts AS visit_date, CAST(ts AS DATE) AS visit_day,
 CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'rejected' ELSE 'pending' END AS status, event_type, value, props,
 CAST(json_extract_string(props, '$.k') AS INT) AS k, (event_id * 7) % 60 AS age_months,
 CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'female_child' ELSE 'male_child' END AS gender,
 CASE WHEN event_id % 13 = 0 THEN '' WHEN (event_id + user_id) % 5 = 0 THEN 'yes' ELSE 'no' END AS unwell,
 9.5::DOUBLE + CAST((event_id * 37 + user_id) % 120 AS DOUBLE) / 10.0::DOUBLE AS muac_cm, user_id * 100 + event_id % 40 AS case_id,
 9.0::DOUBLE + CAST(CAST(json_extract_string(props, '$.k') AS INT) AS DOUBLE) / 1000.0::DOUBLE AS latitude,
 7.0::DOUBLE + CAST(event_id % 100 AS DOUBLE) / 1000.0::DOUBLE AS longitude FROM events)"""
ANSWERS_SQL = "answers AS (SELECT *, " + ", ".join(a.replace("9.5", "9.5::DOUBLE").replace("10.0", "10.0::DOUBLE").replace("11.5", "11.5::DOUBLE") for a in _ANSWERS) + " FROM visits)"
DUS_SQL = """dus AS (SELECT o.o_orderkey AS du_name, c.c_nationkey AS service_area_id, o.o_custkey AS flw_id,
 CASE o.o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'visited' ELSE 'unvisited' END AS status,
 COUNT(l.l_orderkey) AS buildings, CAST(COALESCE(SUM(l.l_quantity), 0) AS BIGINT) AS delivery_count,
 o.o_totalprice AS surface_area, o.o_orderdate AS checked_in_date, MAX(l.l_shipdate) AS checked_out_date
 FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey
 GROUP BY o.o_orderkey, c.c_nationkey, o.o_custkey, o.o_orderstatus, o.o_totalprice, o.o_orderdate)"""
CELLS_SQL = "cells AS (SELECT CAST(p_partkey AS BIGINT) // 50 AS row, p_partkey % 50 AS col, CAST(p_size AS DOUBLE) AS population, p_brand AS ward_id FROM part)"


def with_views(body: str) -> str:
    """A query over visits, dus and cells; the body may begin with further common table expressions ('a AS (...), ... SELECT')."""
    wanted = body + " visits" if "answers" in body else body
    parts = [sql for name, sql in (("visits", VISITS_SQL), ("answers", ANSWERS_SQL), ("dus", DUS_SQL), ("cells", CELLS_SQL)) if name in wanted]
    body = body.strip()
    further = "" if body.upper().startswith("SELECT") else ", "
    return "WITH " + ", ".join(parts) + (further or " ") + body
