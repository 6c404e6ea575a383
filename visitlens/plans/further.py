"""Rarer operators: polygons, ellipsoid distances, perturbations, reference rows, long summaries, success counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visitlens.functions.columns import haversine_km, percent, ratio
from visitlens.functions.geodesy import geodesic_m
from visitlens.operators.overlay import inside
from visitlens.registry import query
from visitlens.sources.views import cells, delivery_units, table, visits, with_views

RADIUS = 0.01237


def ward_polygons(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("n_nationkey").cast("bigint")
    w = table(spark, d, "nation").select(key.alias("ward"), (7.01 + (key % 5) * 0.02).alias("cx"), (9.01 + (key % 4) * 0.025).alias("cy"))
    r = RADIUS
    return w.select("ward", F.array(F.col("cx") + r, F.col("cx"), F.col("cx") - r, F.col("cx")).alias("xs"), F.array(F.col("cy"), F.col("cy") + r, F.col("cy"), F.col("cy") - r).alias("ys"))


WARDS_SQL = "wards AS (SELECT CAST(n_nationkey AS BIGINT) AS ward, 7.01::DOUBLE + (n_nationkey % 5) * 0.02::DOUBLE AS cx, 9.01::DOUBLE + (n_nationkey % 4) * 0.025::DOUBLE AS cy FROM nation)"


@query("join_point_in_polygon", with_views(WARDS_SQL + f" SELECT ward, COUNT(*) AS visits, COUNT(DISTINCT flw_id) AS flws FROM wards JOIN visits ON ABS(longitude - cx) + ABS(latitude - cy) < {RADIUS} GROUP BY ward"))
def point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    """Visits and the wards they are in: buckets of the wards' bounding boxes first, then the even-odd rule."""
    size = 0.01
    bucket = lambda c: F.floor(c / size).cast("int")
    w = ward_polygons(spark, d)
    spread = w.select("*", F.explode(F.sequence(bucket(F.array_min("xs")), bucket(F.array_max("xs")))).alias("a")).select("*", F.explode(F.sequence(bucket(F.array_min("ys")), bucket(F.array_max("ys")))).alias("b"))
    v = visits(spark, d).select("flw_id", "longitude", "latitude", bucket(F.col("longitude")).alias("a"), bucket(F.col("latitude")).alias("b"))
    hit = v.join(spread, ["a", "b"]).where(inside(F.col("longitude"), F.col("latitude"), F.col("xs"), F.col("ys")))
    return hit.groupBy("ward").agg(F.count("*").alias("visits"), F.count_distinct("flw_id").alias("flws"))


@query("join_cell_in_polygon", with_views(WARDS_SQL + f", c AS (SELECT row, col, population, 7.0::DOUBLE + (col + 0.5) * 0.002::DOUBLE AS x, 9.0::DOUBLE + (row + 0.5) * 0.0025::DOUBLE AS y FROM cells) SELECT row, col, MIN(ward) AS ward FROM c JOIN wards ON ABS(x - cx) + ABS(y - cy) < {RADIUS} GROUP BY row, col"))
def cell_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    """Cells whose centre is in a ward; a cell of several wards goes to the first."""
    size = 0.01
    bucket = lambda c: F.floor(c / size).cast("int")
    w = ward_polygons(spark, d)
    spread = w.select("*", F.explode(F.sequence(bucket(F.array_min("xs")), bucket(F.array_max("xs")))).alias("a")).select("*", F.explode(F.sequence(bucket(F.array_min("ys")), bucket(F.array_max("ys")))).alias("b"))
    c = cells(spark, d).select("row", "col", (7.0 + (F.col("col") + 0.5) * 0.002).alias("x"), (9.0 + (F.col("row") + 0.5) * 0.0025).alias("y")).withColumns({"a": bucket(F.col("x")), "b": bucket(F.col("y"))})
    return c.join(spread, ["a", "b"]).where(inside(F.col("x"), F.col("y"), F.col("xs"), F.col("ys"))).groupBy("row", "col").agg(F.min("ward").alias("ward"))


def geodesic_km(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """Kilometres along the ellipsoid between places in degrees, opposite ones included."""
    return geodesic_m(lat1, lon1, lat2, lon2) / 1000


@query("udf_geodesic_distance")
def geodesic_distance(spark: SparkSession, d: str) -> DataFrame:
    """Steps of a worker's day on the ellipsoid, beside those on the sphere."""
    w = Window.partitionBy("flw_id", "visit_day").orderBy("visit_date", "visit_id")
    v = visits(spark, d).select("visit_id", "latitude", "longitude", F.lag("latitude").over(w).alias("lat0"), F.lag("longitude").over(w).alias("lon0")).where("lat0 IS NOT NULL")
    v = v.withColumn("sphere_km", haversine_km(F.col("lat0"), F.col("lon0"), F.col("latitude"), F.col("longitude")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            km = geodesic_km(*(b[c].to_numpy(float) for c in ("lat0", "lon0", "latitude", "longitude")))
            yield pd.DataFrame({"visit_id": b["visit_id"], "km": np.round(km, 6), "sphere_km": b["sphere_km"].round(6)})

    return v.mapInPandas(run, "visit_id bigint, km double, sphere_km double")


@query("aggr_tampering_impact", with_views("""x AS (SELECT flw_id, muac_cm, CASE WHEN (visit_id * 2654435761) % 4294967296 % 100 < 20 THEN muac_cm + (2 + (visit_id * 40503) % 5) * CASE WHEN visit_id % 2 = 0 THEN 1 ELSE -1 END ELSE muac_cm END AS noisy FROM visits)
SELECT flw_id, ROUND(stddev_samp(muac_cm), 6) AS sd_before, ROUND(stddev_samp(noisy), 6) AS sd_after, COUNT(*) FILTER (WHERE noisy <> muac_cm) AS tampered FROM x GROUP BY flw_id"""))
def tampering_impact(spark: SparkSession, d: str) -> DataFrame:
    """A fifth of the measurements moved by two to six either way, the same ones each time; spreads before and after."""
    i = F.col("visit_id")
    noise = (2 + (i * 40503) % 5) * F.when(i % 2 == 0, 1).otherwise(-1)
    x = visits(spark, d).withColumn("noisy", F.when((i * 2654435761) % 4294967296 % 100 < 20, F.col("muac_cm") + noise).otherwise(F.col("muac_cm")))
    return x.groupBy("flw_id").agg(F.round(F.stddev_samp("muac_cm"), 6).alias("sd_before"), F.round(F.stddev_samp("noisy"), 6).alias("sd_after"), F.count_if(F.col("noisy") != F.col("muac_cm")).alias("tampered"))


@query("aggr_baseline_reference_row", with_views("""f AS (SELECT CAST(flw_id AS VARCHAR) AS flw, COUNT(*) FILTER (WHERE gender = 'female_child') * 1.0 / COUNT(gender) AS female FROM visits GROUP BY flw_id)
SELECT 'BASELINE' AS flw, ROUND(COUNT(*) FILTER (WHERE gender = 'female_child') * 1.0 / COUNT(gender), 6) AS female FROM visits UNION ALL SELECT flw, ROUND(female, 6) FROM f"""))
def baseline_reference_row(spark: SparkSession, d: str) -> DataFrame:
    """The population's row above the workers', by grouping sets."""
    girl = F.count_if(F.col("gender") == "female_child")
    g = visits(spark, d).rollup("flw_id").agg(F.round(ratio(girl, F.count("gender"), None), 6).alias("female"), F.grouping("flw_id").alias("all"))
    return g.select(F.when(F.col("all") == 1, "BASELINE").otherwise(F.col("flw_id").cast("string")).alias("flw"), "female")


@query("aggr_assessment_summary", with_views("""a AS (SELECT flw_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE age_months < 12) < 0.2 * COUNT(*) AS sn FROM visits GROUP BY flw_id), s AS (SELECT COUNT(*) AS flws, COUNT(*) FILTER (WHERE sn) AS sn, COUNT(*) FILTER (WHERE n < 55) AS few FROM a)
SELECT UNNEST(['flws', 'strong_negative', 'insufficient']) AS metric, UNNEST([flws, sn, few]) AS value FROM s"""))
def assessment_summary(spark: SparkSession, d: str) -> DataFrame:
    a = visits(spark, d).groupBy("flw_id").agg(F.count("*").alias("n"), (F.count_if(F.col("age_months") < 12) < 0.2 * F.count("*")).alias("sn"))
    s = a.agg(F.count("*").alias("flws"), F.count_if("sn").alias("strong_negative"), F.count_if(F.col("n") < 55).alias("insufficient"))
    return s.unpivot([], ["flws", "strong_negative", "insufficient"], "metric", "value")


@query("aggr_success_by_type", with_views("SELECT event_type, COUNT(*) AS attempted, COUNT(*) FILTER (WHERE status = 'approved') AS succeeded, COUNT(*) FILTER (WHERE status = 'rejected') AS failed, ROUND(100.0 * COUNT(*) FILTER (WHERE status = 'approved') / COUNT(*), 4) AS success_pct FROM visits GROUP BY event_type"))
def success_by_type(spark: SparkSession, d: str) -> DataFrame:
    good = F.count_if(F.col("status") == "approved")
    return visits(spark, d).groupBy("event_type").agg(F.count("*").alias("attempted"), good.alias("succeeded"), F.count_if(F.col("status") == "rejected").alias("failed"), F.round(percent(good, F.count("*")), 4).alias("success_pct"))


@query("aggr_numeric_field_share", "SELECT ROUND(AVG(CASE WHEN TRY_CAST(c_mktsegment AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS segment, ROUND(AVG(CASE WHEN TRY_CAST(CAST(c_acctbal AS VARCHAR) AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS balance FROM customer")
def numeric_field_share(spark: SparkSession, d: str) -> DataFrame:
    """How much of a text column can be read as numbers."""
    share = lambda c: F.round(F.avg(F.expr(f"CASE WHEN try_cast(CAST({c} AS STRING) AS DOUBLE) IS NOT NULL THEN 1.0D ELSE 0.0D END")), 6)
    return table(spark, d, "customer").agg(share("c_mktsegment").alias("segment"), share("c_acctbal").alias("balance"))


@query("aggr_clumped_dus", with_views("SELECT service_area_id, COUNT(*) FILTER (WHERE delivery_count > 10 * buildings) AS clumped, COUNT(DISTINCT flw_id) FILTER (WHERE delivery_count > 10 * buildings) AS flws FROM dus GROUP BY service_area_id"))
def clumped_dus(spark: SparkSession, d: str) -> DataFrame:
    """Units with over ten deliveries for each building; no division, so none by zero."""
    clumped = F.col("delivery_count") > 10 * F.col("buildings")
    return delivery_units(spark, d).groupBy("service_area_id").agg(F.count_if(clumped).alias("clumped"), F.count_distinct(F.when(clumped, F.col("flw_id"))).alias("flws"))


@query("aggr_case_mode_and_steps", with_views("""s AS (SELECT case_id, event_type, visit_date, visit_id, value - LAG(value) OVER (PARTITION BY case_id ORDER BY visit_date, visit_id) AS step FROM visits),
c AS (SELECT case_id, event_type, COUNT(*) AS n FROM visits GROUP BY ALL), m AS (SELECT case_id, arg_max(event_type, row(n, event_type)) AS mode FROM c GROUP BY case_id)
SELECT s.case_id, ANY_VALUE(m.mode) AS mode, ROUND(AVG(step), 6) AS mean_step, COUNT(*) AS visits FROM s JOIN m USING (case_id) GROUP BY s.case_id"""))
def case_mode_and_steps(spark: SparkSession, d: str) -> DataFrame:
    """A case's commonest type, ties by name, and the mean change between its visits."""
    v = visits(spark, d)
    step = F.col("value") - F.lag("value").over(Window.partitionBy("case_id").orderBy("visit_date", "visit_id"))
    modes = v.groupBy("case_id", "event_type").agg(F.count("*").alias("n")).groupBy("case_id").agg(F.max_by("event_type", F.struct("n", "event_type")).alias("mode"))
    steps = v.withColumn("step", step).groupBy("case_id").agg(F.round(F.avg("step"), 6).alias("mean_step"), F.count("*").alias("visits"))
    return steps.join(modes, "case_id")


@query("aggr_grid_resolution_totals", with_views("SELECT res, COUNT(*) AS cells, SUM(p) AS population FROM (SELECT 100 AS res, row, col, SUM(population) AS p FROM cells GROUP BY ALL UNION ALL SELECT 200, row // 2, col // 2, SUM(population) FROM cells GROUP BY row // 2, col // 2 UNION ALL SELECT 300, row // 3, col // 3, SUM(population) FROM cells GROUP BY row // 3, col // 3) GROUP BY res"))
def grid_resolution_totals(spark: SparkSession, d: str) -> DataFrame:
    scale = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("s")
    c = cells(spark, d).select("row", "col", "population", scale)
    parents = c.groupBy("s", F.floor(F.col("row") / F.col("s")).alias("r"), F.floor(F.col("col") / F.col("s")).alias("c")).agg(F.sum("population").alias("p"))
    return parents.groupBy((F.col("s") * 100).alias("res")).agg(F.count("*").alias("cells"), F.sum("p").alias("population"))
