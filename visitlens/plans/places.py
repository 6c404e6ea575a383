"""Wards, plans and ways in full: polygons that points and cells meet, summaries of wards, plans and cases, outlines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visitlens.functions.columns import haversine_km, percent, ratio, sorted_list
from visitlens.operators.graph import min_label_components
from visitlens.operators.overlay import inside
from visitlens.plans.further import RADIUS, WARDS_SQL, ward_polygons
from visitlens.plans.grid import VISIT_CELLS_SQL, hull, visit_cells
from visitlens.plans.ordered import BY_TIME, HAVERSINE_SQL, STEPS_SQL, steps
from visitlens.registry import query
from visitlens.sources.views import cells, delivery_units, table, visits, with_views

BUFFER = 0.004


def _edges(xs: Column, ys: Column) -> Column:
    n = F.size(xs)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(xs, i).alias("x1"), F.get(ys, i).alias("y1"), F.get(xs, (i + 1) % n).alias("x2"), F.get(ys, (i + 1) % n).alias("y2")))


def distance_to(x: Column, y: Column, xs: Column, ys: Column) -> Column:
    """Distance of a point from a polygon, 0 inside it, in the units of its coordinates."""

    def to_edge(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - e["x1"]) * dx + (y - e["y1"]) * dy) / (dx * dx + dy * dy)))
        return F.hypot(x - e["x1"] - t * dx, y - e["y1"] - t * dy)

    return F.when(inside(x, y, xs, ys), 0.0).otherwise(F.array_min(F.transform(_edges(xs, ys), to_edge)))


def meets_rectangle(x0: Column, y0: Column, x1: Column, y1: Column, xs: Column, ys: Column) -> Column:
    """Whether a polygon and an upright rectangle have a point in common: a corner of one in the other, or edges that cross."""
    corner_in = inside(x0, y0, xs, ys) | inside(x1, y0, xs, ys) | inside(x0, y1, xs, ys) | inside(x1, y1, xs, ys)

    def crosses(e: Column) -> Column:
        """An edge is cut to the rectangle, side by side; something is left of it where they meet."""
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        low, high = F.lit(0.0), F.lit(1.0)
        for d, a, b, at in ((dx, x0, x1, e["x1"]), (dy, y0, y1, e["y1"])):
            t0, t1 = (a - at) / d, (b - at) / d
            still = F.when((at >= a) & (at <= b), F.lit(1.0)).otherwise(F.lit(-1.0))
            low = F.greatest(low, F.when(d == 0, F.lit(0.0)).otherwise(F.least(t0, t1)))
            high = F.least(high, F.when(d == 0, still).otherwise(F.greatest(t0, t1)))
        return low <= high

    return corner_in | F.exists(_edges(xs, ys), crosses)


def _around(polygons: DataFrame, size: float, margin: float) -> DataFrame:
    """polygons in each bucket (a, b) that their bounding box, widened by margin, reaches."""
    bucket = lambda c: F.floor(c / size).cast("int")
    over = lambda c: F.explode(F.sequence(bucket(F.array_min(c) - margin), bucket(F.array_max(c) + margin)))
    return polygons.select("*", over("xs").alias("a")).select("*", over("ys").alias("b"))


_NEAR = "sqrt(pow(u - r + t * r, 2) + pow(v - t * r, 2))"


@query("join_points_left_polygons", with_views(WARDS_SQL + f""", p AS (SELECT visit_id, flw_id, ward, ABS(longitude - cx) AS u, ABS(latitude - cy) AS v, {RADIUS}::DOUBLE AS r FROM visits, wards), q AS (SELECT *, LEAST(1, GREATEST(0, (v - u + r) / (2 * r))) AS t FROM p),
h AS (SELECT visit_id, flw_id, ward FROM q WHERE u + v < r OR {_NEAR} <= {BUFFER}), j AS (SELECT visits.visit_id, visits.flw_id, h.ward FROM visits LEFT JOIN h ON h.visit_id = visits.visit_id)
SELECT ward, COUNT(*) AS visits, COUNT(DISTINCT flw_id) AS flws FROM j GROUP BY ward HAVING COUNT(*) >= 5"""))
def points_left_polygons(spark: SparkSession, d: str) -> DataFrame:
    """Visits with the wards they are in or within a buffer of: a visit of two wards counts in both, one of none under null; only
    wards with five visits or more."""
    size = 0.01
    spread = _around(ward_polygons(spark, d), size, BUFFER)
    v = visits(spark, d).select("visit_id", "flw_id", "longitude", "latitude").withColumns({"a": F.floor(F.col("longitude") / size).cast("int"), "b": F.floor(F.col("latitude") / size).cast("int")})
    near = distance_to(F.col("longitude"), F.col("latitude"), F.col("xs"), F.col("ys")) <= BUFFER
    hits = v.join(spread, ["a", "b"]).where(near).select("visit_id", "ward")
    return v.join(hits, "visit_id", "left").groupBy("ward").agg(F.count("*").alias("visits"), F.count_distinct("flw_id").alias("flws")).where("visits >= 5")


@query("join_cells_meet_polygons", with_views(WARDS_SQL + f""", c AS (SELECT row, col, 7.0::DOUBLE + col * 0.002::DOUBLE AS x0, 7.0::DOUBLE + (col + 1) * 0.002::DOUBLE AS x1, 9.0::DOUBLE + row * 0.0025::DOUBLE AS y0, 9.0::DOUBLE + (row + 1) * 0.0025::DOUBLE AS y1 FROM cells)
SELECT row, col, MIN(ward) AS ward, arg_min(GREATEST(ABS(x0 - cx), ABS(x1 - cx)) + GREATEST(ABS(y0 - cy), ABS(y1 - cy)) < {RADIUS}, ward) AS is_whole FROM c JOIN wards ON GREATEST(x0 - cx, 0, cx - x1) + GREATEST(y0 - cy, 0, cy - y1) < {RADIUS} GROUP BY row, col"""))
def cells_meet_polygons(spark: SparkSession, d: str) -> DataFrame:
    """Cells that a ward covers in part or whole; a cell of several wards goes to the first."""
    size = 0.01
    x, y = lambda i: 7.0 + (F.col("col") + i) * 0.002, lambda i: 9.0 + (F.col("row") + i) * 0.0025
    corners = cells(spark, d).select("row", "col", x(0).alias("x0"), x(1).alias("x1"), y(0).alias("y0"), y(1).alias("y1"))
    bucket = lambda c: F.floor(F.col(c) / size).cast("int")
    over = lambda a, b: F.explode(F.sequence(bucket(a), bucket(b)))
    keyed = corners.select("*", over("x0", "x1").alias("a")).select("*", over("y0", "y1").alias("b"))
    xs, ys, box = F.col("xs"), F.col("ys"), [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    met = keyed.join(_around(ward_polygons(spark, d), size, 0.0), ["a", "b"]).where(meets_rectangle(*box, xs, ys))
    whole = F.lit(True)
    for i in ("x0", "x1"):
        for j in ("y0", "y1"):
            whole = whole & inside(F.col(i), F.col(j), xs, ys)  # the wards are convex
    return met.groupBy("row", "col").agg(F.min("ward").alias("ward"), F.min_by(whole, "ward").alias("is_whole"))


_BUILDINGS_SQL = "bl AS (SELECT p_partkey // 50 AS row, p_partkey % 50 AS col, COUNT(*) AS num_buildings, SUM(l_quantity) AS area FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)"


@query("aggr_ward_summary", with_views(VISIT_CELLS_SQL + f""", {_BUILDINGS_SQL}, a AS (SELECT row, col, COUNT(*) AS n FROM vc GROUP BY row, col),
o AS (SELECT c.ward_id, COUNT(DISTINCT opportunity_id) AS opps, string_agg(DISTINCT opportunity_name, ';' ORDER BY opportunity_name) AS opportunity_names, COUNT(DISTINCT flw_id) AS unique_flws FROM vc JOIN cells c ON c.row = vc.row AND c.col = vc.col GROUP BY c.ward_id),
w AS (SELECT ward_id, 'Ward ' || ward_id AS ward_name, 'State ' || left(ward_id, 7) AS state_name, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS total_visits, COUNT(*) AS total_cells, COUNT(*) FILTER (WHERE population > 0) AS total_cells_with_pop, COUNT(n) AS visited_cells, COUNT(*) - COUNT(n) AS unvisited_cells,
 SUM(population) AS total_population, COALESCE(SUM(population) FILTER (WHERE n > 0), 0) AS visited_population, CAST(COALESCE(SUM(num_buildings), 0) AS BIGINT) AS total_buildings, CAST(COALESCE(SUM(num_buildings) FILTER (WHERE n > 0), 0) AS BIGINT) AS buildings_in_visited_cells, COALESCE(SUM(area), 0) AS total_building_area
 FROM cells c LEFT JOIN a ON a.row = c.row AND a.col = c.col LEFT JOIN bl ON bl.row = c.row AND bl.col = c.col GROUP BY ward_id)
SELECT w.ward_id, ward_name, state_name, COALESCE(opps, 0) AS unique_opportunities, COALESCE(opportunity_names, '') AS opportunity_names, COALESCE(unique_flws, 0) AS unique_flws, total_visits, total_cells, total_cells_with_pop, visited_cells, unvisited_cells, total_population, visited_population, total_population - visited_population AS unvisited_population,
 ROUND(1000.0 * total_visits / total_population, 6) AS visits_per_1000_people, ROUND(total_visits / (total_population * 0.18), 6) AS visits_per_expected, ROUND(COALESCE(total_visits / NULLIF(visited_population * 0.18, 0), 0), 6) AS visits_per_expected_visited, ROUND(visited_cells * 1.0 / total_cells_with_pop, 6) AS visited_cell_share, ROUND(visited_population / total_population, 6) AS visited_population_share,
 total_buildings, buildings_in_visited_cells, total_buildings - buildings_in_visited_cells AS buildings_in_unvisited_cells, ROUND(total_building_area, 4) AS total_building_area_m2, ROUND(COALESCE(total_population / NULLIF(total_buildings, 0), 0), 6) AS population_per_building, ROUND(1000.0 * total_buildings / total_population, 6) AS buildings_per_1000_people FROM w LEFT JOIN o ON o.ward_id = w.ward_id"""))
def ward_summary(spark: SparkSession, d: str) -> DataFrame:
    """Twenty-five figures of each ward: cells, people, visits and buildings, reached and not."""
    v = visit_cells(visits(spark, d)).select("row", "col", "flw_id", "opportunity_id", "opportunity_name")
    c = cells(spark, d)
    n = v.groupBy("row", "col").agg(F.count("*").alias("n"))
    b = table(spark, d, "lineitem").groupBy(F.expr("l_partkey div 50").alias("row"), (F.col("l_partkey") % 50).alias("col")).agg(F.count("*").alias("num"), F.sum("l_quantity").alias("area"))
    o = v.join(c.select("row", "col", "ward_id"), ["row", "col"]).groupBy("ward_id").agg(F.count_distinct("opportunity_id").alias("opps"), sorted_list("opportunity_name").alias("names"), F.count_distinct("flw_id").alias("flws"))
    seen = lambda x: F.coalesce(F.sum(F.when(F.col("n") > 0, F.col(x))), F.lit(0))
    zero = lambda x: F.coalesce(x, F.lit(0))
    w = c.join(n, ["row", "col"], "left").join(b, ["row", "col"], "left").groupBy("ward_id").agg(
        zero(F.sum("n")).alias("total_visits"), F.count("*").alias("total_cells"), F.count_if(F.col("population") > 0).alias("total_cells_with_pop"), F.count("n").alias("visited_cells"), (F.count("*") - F.count("n")).alias("unvisited_cells"),
        F.sum("population").alias("total_population"), seen("population").cast("double").alias("visited_population"), zero(F.sum("num")).alias("total_buildings"), seen("num").alias("buildings_in_visited_cells"), F.round(zero(F.sum("area")), 4).alias("total_building_area_m2"),
    )
    share = lambda a, b: F.round(ratio(a, b), 6)
    pop, met, visited = F.col("total_population"), F.col("visited_population"), F.col("total_visits")
    figures = {
        "ward_name": F.concat(F.lit("Ward "), "ward_id"), "state_name": F.concat(F.lit("State "), F.substring("ward_id", 1, 7)), "unvisited_population": pop - met, "visits_per_1000_people": share(1000.0 * visited, pop),
        "visits_per_expected": share(visited, pop * 0.18), "visits_per_expected_visited": share(visited, met * 0.18), "visited_cell_share": share("visited_cells", "total_cells_with_pop"), "visited_population_share": share(met, pop),
        "buildings_in_unvisited_cells": F.col("total_buildings") - F.col("buildings_in_visited_cells"), "population_per_building": share(pop, "total_buildings"), "buildings_per_1000_people": share(1000.0 * F.col("total_buildings"), pop),
        "unique_opportunities": zero(F.col("opps")), "opportunity_names": F.coalesce("names", F.lit("")), "unique_flws": zero(F.col("flws")),
    }
    return w.join(o, "ward_id", "left").withColumns(figures).drop("opps", "names", "flws")


LIMITS = (50, 100, 200, 500)
_CLUSTERS_SQL = """c AS (SELECT ward_id, row, col, row * 50 + col AS id, population FROM cells WHERE population > 20), e AS (SELECT a.id AS u, b.id AS v FROM c a JOIN c b ON a.ward_id = b.ward_id AND ABS(a.row - b.row) + ABS(a.col - b.col) = 1),
r AS (SELECT id, id AS root FROM c UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.id), l AS (SELECT id, MIN(root) AS component FROM r GROUP BY id), vn AS (SELECT CAST(FLOOR((latitude - 9.0) / 0.0025) AS BIGINT) AS row, CAST(FLOOR((longitude - 7.0) / 0.002) AS BIGINT) AS col, COUNT(*) AS n FROM visits GROUP BY ALL),
h AS (SELECT ward_id, component, SUM(population) AS p, COUNT(*) AS size, COALESCE(SUM(n), 0) AS visits FROM c JOIN l ON l.id = c.id LEFT JOIN vn ON vn.row = c.row AND vn.col = c.col GROUP BY ward_id, component)"""


def _bucket_sql(name: str, test: str) -> str:
    return f"""COUNT(*) FILTER (WHERE {test}) AS clusters_{name}, COALESCE(SUM(p) FILTER (WHERE {test}), 0) AS population_{name}, ROUND(100.0 * COALESCE(SUM(p) FILTER (WHERE {test}), 0) / SUM(p), 6) AS pct_population_{name},
 COALESCE(quantile_cont(size, 0.5) FILTER (WHERE {test}), 0) AS median_size_{name}, COUNT(*) FILTER (WHERE {test} AND visits > 0) AS visited_{name}, ROUND(COALESCE(100.0 * SUM(p) FILTER (WHERE {test} AND visits > 0) / NULLIF(SUM(p) FILTER (WHERE {test}), 0), 0), 6) AS pct_visited_{name}"""


BUCKETS = {**{f"upto_{t}": f"p <= {t}" for t in LIMITS}, "from_100_to_500": "p > 100 AND p <= 500", "over_500": "p > 500"}


@query("aggr_hamlet_buckets", "WITH RECURSIVE " + with_views(_CLUSTERS_SQL + " SELECT ward_id, COUNT(*) AS clusters, SUM(p) AS population, CAST(SUM(visits) AS BIGINT) AS visits, quantile_cont(size, 0.5) AS median_size, quantile_cont(p, 0.5) AS median_population, " + ", ".join(_bucket_sql(k, t) for k, t in BUCKETS.items()) + " FROM h GROUP BY ward_id").removeprefix("WITH "))
def hamlet_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of neighbouring peopled cells by how many live there: their number, people, size, and what is visited of them."""
    c = cells(spark, d).where("population > 20").withColumn("id", F.col("row") * 50 + F.col("col"))
    step = F.explode(F.array(F.struct(F.lit(0).alias("dr"), F.lit(1).alias("dc")), F.struct(F.lit(1).alias("dr"), F.lit(0).alias("dc"))))
    to = c.select("ward_id", F.col("id").alias("u"), "row", "col", step.alias("s")).select("ward_id", "u", (F.col("row") + F.col("s.dr")).alias("row"), (F.col("col") + F.col("s.dc")).alias("col"))
    labels = min_label_components(c.select("id"), to.join(c, ["ward_id", "row", "col"]).select("u", F.col("id").alias("v")))
    n = visit_cells(visits(spark, d)).groupBy("row", "col").agg(F.count("*").alias("n"))
    h = c.join(labels, "id").join(n, ["row", "col"], "left").groupBy("ward_id", "component").agg(F.sum("population").alias("p"), F.count("*").alias("size"), F.coalesce(F.sum("n"), F.lit(0)).alias("visits"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))

    def bucket(name: str, test: str) -> list[Column]:
        own, seen = F.expr(test), F.expr(f"{test} AND visits > 0")
        people = lambda t: zero(F.sum(F.when(t, F.col("p"))))
        return [F.count_if(own).alias(f"clusters_{name}"), people(own).alias(f"population_{name}"), F.round(percent(people(own), F.sum("p")), 6).alias(f"pct_population_{name}"), zero(F.percentile(F.when(own, F.col("size")), 0.5)).alias(f"median_size_{name}"), F.count_if(seen).alias(f"visited_{name}"), F.round(percent(people(seen), people(own)), 6).alias(f"pct_visited_{name}")]

    return h.groupBy("ward_id").agg(F.count("*").alias("clusters"), F.sum("p").alias("population"), F.sum("visits").alias("visits"), F.percentile("size", 0.5).alias("median_size"), F.percentile("p", 0.5).alias("median_population"), *(x for k, t in BUCKETS.items() for x in bucket(k, t)))


_PLAN_SQL = "pl AS (SELECT *, 7.0::DOUBLE + (du_name % 100) / 1000.0::DOUBLE AS x, 9.0::DOUBLE + (du_name // 100 % 100) / 1000.0::DOUBLE AS y FROM dus), sa AS (SELECT service_area_id, COUNT(*) AS units, CAST(SUM(buildings) AS BIGINT) AS buildings, MIN(flw_id) AS flw_id, 100.0 * COUNT(*) FILTER (WHERE buildings = 1) / COUNT(*) AS one_pct, 100.0 * COUNT(*) FILTER (WHERE buildings <= 5) / COUNT(*) AS five_pct, (MAX(x) + 0.0005 - MIN(x)) * cos(radians((MIN(y) + MAX(y) + 0.0005) / 2)) * 111 * (MAX(y) + 0.0005 - MIN(y)) * 111 AS km2 FROM pl GROUP BY service_area_id)"


def planned_areas(spark: SparkSession, d: str) -> DataFrame:
    """One row for each service area of the plan: units, buildings, shares of small units, bounding box."""
    k = F.col("du_name")
    p = delivery_units(spark, d).withColumns({"x": 7.0 + (k % 100) / 1000.0, "y": 9.0 + (F.expr("du_name div 100") % 100) / 1000.0})
    width, height = F.max("x") + 0.0005 - F.min("x"), F.max("y") + 0.0005 - F.min("y")
    km2 = width * F.cos(F.radians((F.min("y") + F.max("y") + 0.0005) / 2)) * 111 * height * 111
    share = lambda c: percent(F.count_if(c), F.count("*"))
    return p.groupBy("service_area_id").agg(F.count("*").alias("units"), F.sum("buildings").alias("buildings"), F.min("flw_id").alias("flw_id"), share(F.col("buildings") == 1).alias("one_pct"), share(F.col("buildings") <= 5).alias("five_pct"), km2.alias("km2"))


@query("aggr_plan_areas", with_views(_PLAN_SQL + " SELECT service_area_id, units, buildings, flw_id, ROUND(one_pct, 4) AS one_pct, ROUND(five_pct, 4) AS five_pct, ROUND(km2, 4) AS bbox_km2 FROM sa"))
def plan_areas(spark: SparkSession, d: str) -> DataFrame:
    return planned_areas(spark, d).select("service_area_id", "units", "buildings", "flw_id", F.round("one_pct", 4).alias("one_pct"), F.round("five_pct", 4).alias("five_pct"), F.round("km2", 4).alias("bbox_km2"))


@query("aggr_plan_workers", with_views(_PLAN_SQL + " SELECT flw_id % 7 AS team, COUNT(*) AS areas, CAST(SUM(units) AS BIGINT) AS units, CAST(SUM(buildings) AS BIGINT) AS buildings, ROUND(100.0 * COUNT(*) FILTER (WHERE buildings >= 2400) / COUNT(*), 4) AS large_pct, ROUND(SUM(km2), 4) AS bbox_km2, COALESCE(MAX(CASE WHEN buildings >= 2400 THEN service_area_id END) < MIN(CASE WHEN buildings < 2400 THEN service_area_id END), true) AS large_first FROM sa GROUP BY 1"))
def plan_workers(spark: SparkSession, d: str) -> DataFrame:
    """A team's areas in their order: sums, the share of large ones, and whether all of these come before the others."""
    large = F.col("buildings") >= 2400
    order = F.max(F.when(large, F.col("service_area_id"))) < F.min(F.when(~large, F.col("service_area_id")))
    return planned_areas(spark, d).groupBy((F.col("flw_id") % 7).alias("team")).agg(F.count("*").alias("areas"), F.sum("units").alias("units"), F.sum("buildings").alias("buildings"), F.round(percent(F.count_if(large), F.count("*")), 4).alias("large_pct"), F.round(F.sum("km2"), 4).alias("bbox_km2"), F.coalesce(order, F.lit(True)).alias("large_first"))


_HAV = lambda a, b, c, d: HAVERSINE_SQL.format(a=a, b=b, c=c, d=d)


@query("aggr_case_locations", with_views(f"""r AS (SELECT *, ROW_NUMBER() OVER w AS i, LAG(latitude) OVER w AS lat0, LAG(longitude) OVER w AS lon0, FIRST_VALUE(latitude) OVER w AS lat1, FIRST_VALUE(longitude) OVER w AS lon1, AVG(latitude) OVER (PARTITION BY case_id) AS clat, AVG(longitude) OVER (PARTITION BY case_id) AS clon FROM visits WINDOW w AS (PARTITION BY case_id ORDER BY visit_date, visit_id))
SELECT case_id, COUNT(*) AS visits, ROUND(MAX(latitude) - MIN(latitude), 6) AS lat_span, ROUND(MAX(longitude) - MIN(longitude), 6) AS lon_span, ROUND(COALESCE(SUM({_HAV('lat0', 'latitude', 'lon0', 'longitude')}), 0), 5) AS total_km, ROUND(MAX({_HAV('lat1', 'latitude', 'lon1', 'longitude')}), 5) AS max_km_from_first, ROUND(AVG({_HAV('clat', 'latitude', 'clon', 'longitude')}), 5) AS mean_km_from_centroid, """ + ", ".join(f"MAX(latitude) FILTER (WHERE i = {i}) AS lat_{i}, MAX(longitude) FILTER (WHERE i = {i}) AS lon_{i}" for i in range(1, 7)) + " FROM r GROUP BY case_id"))
def case_locations(spark: SparkSession, d: str) -> DataFrame:
    """A case's first six places in columns, its extent, the way between its visits, and how far they are from the first and the middle."""
    each = Window.partitionBy("case_id")
    w = each.orderBy(*BY_TIME)
    lat, lon = F.col("latitude"), F.col("longitude")
    r = visits(spark, d).withColumns({
        "i": F.row_number().over(w), "km": haversine_km(F.lag("latitude").over(w), F.lag("longitude").over(w), lat, lon), "from_first": haversine_km(F.first("latitude").over(w), F.first("longitude").over(w), lat, lon),
        "from_middle": haversine_km(F.avg("latitude").over(each), F.avg("longitude").over(each), lat, lon),
    })
    pick = lambda c, i: F.max(F.when(F.col("i") == i, F.col(c)))
    span = lambda c: F.round(F.max(c) - F.min(c), 6)
    return r.groupBy("case_id").agg(
        F.count("*").alias("visits"), span("latitude").alias("lat_span"), span("longitude").alias("lon_span"), F.round(F.coalesce(F.sum("km"), F.lit(0.0)), 5).alias("total_km"), F.round(F.max("from_first"), 5).alias("max_km_from_first"), F.round(F.avg("from_middle"), 5).alias("mean_km_from_centroid"),
        *(x for i in range(1, 7) for x in (pick("latitude", i).alias(f"lat_{i}"), pick("longitude", i).alias(f"lon_{i}"))),
    )


@query("win_path_segments", with_views(STEPS_SQL + ", p AS (SELECT *, LAG(visit_id) OVER (PARTITION BY flw_id, visit_day ORDER BY visit_date, visit_id) AS from_id FROM s) SELECT flw_id, visit_day, from_id, visit_id AS to_id, ROUND(lat0, 6) AS from_lat, ROUND(lon0, 6) AS from_lon, ROUND(latitude, 6) AS to_lat, ROUND(longitude, 6) AS to_lon, ROUND(km, 5) AS km FROM p WHERE from_id IS NOT NULL"))
def path_segments(spark: SparkSession, d: str) -> DataFrame:
    """The steps of each worker's days as segments, from place to place."""
    w = Window.partitionBy("flw_id", "visit_day").orderBy(*BY_TIME)
    s = steps(visits(spark, d)).withColumns({"from_id": F.lag("visit_id").over(w), "from_lat": F.lag("latitude").over(w), "from_lon": F.lag("longitude").over(w)}).where("from_id IS NOT NULL")
    r = lambda c: F.round(c, 6)
    return s.select("flw_id", "visit_day", "from_id", F.col("visit_id").alias("to_id"), r("from_lat").alias("from_lat"), r("from_lon").alias("from_lon"), r("latitude").alias("to_lat"), r("longitude").alias("to_lon"), F.round("km", 5).alias("km"))


@query("aggr_multipart_dissolve", with_views("""s AS (SELECT ward_id, row, col, col - ROW_NUMBER() OVER (PARTITION BY ward_id, row ORDER BY col) AS run FROM cells), p AS (SELECT ward_id, row, MIN(col) AS a, MAX(col) + 1 AS b FROM s GROUP BY ward_id, row, run)
SELECT ward_id, COUNT(*) AS parts, SUM(b - a)::DOUBLE AS area, 'MULTIPOLYGON (' || string_agg('((' || a || ' ' || row || ', ' || b || ' ' || row || ', ' || b || ' ' || (row + 1) || ', ' || a || ' ' || (row + 1) || ', ' || a || ' ' || row || '))', ', ' ORDER BY row, a) || ')' AS wkt, string_agg(DISTINCT CAST(row AS VARCHAR), ';' ORDER BY CAST(row AS VARCHAR)) AS sources FROM p GROUP BY ward_id"""))
def multipart_dissolve(spark: SparkSession, d: str) -> DataFrame:
    """A ward's cells as one geometry: neighbours of a row become one rectangle, the rectangles the parts of a multipolygon."""
    run = F.col("col") - F.row_number().over(Window.partitionBy("ward_id", "row").orderBy("col"))
    p = cells(spark, d).withColumn("run", run).groupBy("ward_id", "row", "run").agg(F.min("col").alias("a"), (F.max("col") + 1).alias("b"))
    corner = lambda x, up: F.concat(x.cast("string"), F.lit(" "), (F.col("row") + up).cast("string"))
    a, b = F.col("a"), F.col("b")
    ring = F.concat(F.lit("(("), F.concat_ws(", ", corner(a, 0), corner(b, 0), corner(b, 1), corner(a, 1), corner(a, 0)), F.lit("))"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("row", "a", ring.alias("ring")))), lambda x: x["ring"])
    return p.groupBy("ward_id").agg(F.count("*").alias("parts"), F.sum(b - a).cast("double").alias("area"), F.concat(F.lit("MULTIPOLYGON ("), F.array_join(parts, ", "), F.lit(")")).alias("wkt"), sorted_list("row").alias("sources"))


def outline(points: np.ndarray, buffer: float, sides: int = 32) -> np.ndarray:
    """The convex hull of points widened by `buffer`, its corners rounded with `sides` sides to a full turn."""
    turn = 2 * np.pi * np.arange(sides) / sides
    around = (points[:, None] + buffer * np.stack([np.cos(turn), np.sin(turn)], 1)).reshape(-1, 2) if buffer else points
    return hull(around)


def area_of(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2


def proxy_wards(v: DataFrame, key: str, metres: float, most_km: float, least: int) -> DataFrame:
    """(key, visits, used, corners, area, wkt): the hull of a group's places within most_km of their median, widened by a buffer;
    groups with fewer than `least` such visits have none. Places are made distinct, and tasks send corners only."""
    middle = v.groupBy(key).agg(F.count("*").alias("visits"), F.percentile("latitude", 0.5).alias("mlat"), F.percentile("longitude", 0.5).alias("mlon"))
    near = v.join(middle, key).where(haversine_km(F.col("latitude"), F.col("longitude"), F.col("mlat"), F.col("mlon")) <= most_km)
    places = near.groupBy(key, "visits", "longitude", "latitude").agg(F.count("*").alias("n"))
    kind = v.schema[key].dataType.simpleString()

    def corners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (k, n), g in b.groupby([key, "visits"]):
                h = hull(g[["longitude", "latitude"]].to_numpy())
                yield pd.DataFrame({key: k, "visits": n, "used": [int(g["n"].sum())] + [0] * (len(h) - 1), "longitude": h[:, 0], "latitude": h[:, 1]})

    def shape(g: pd.DataFrame) -> pd.DataFrame:
        used = int(g["used"].sum())
        ring = outline(g[["longitude", "latitude"]].to_numpy(), metres / 111_320)
        text = "POLYGON ((" + ", ".join(f"{a:.6f} {b:.6f}" for a, b in [*ring, ring[0]]) + "))"
        row = pd.DataFrame({key: [g[key].iloc[0]], "visits": [g["visits"].iloc[0]], "used": [used], "corners": [len(ring)], "area": [area_of(ring)], "wkt": [text]})
        return row if used >= least else row.iloc[:0]

    few = places.mapInPandas(corners, f"{key} {kind}, visits bigint, used bigint, longitude double, latitude double")
    return few.groupBy(key).applyInPandas(shape, f"{key} {kind}, visits bigint, used bigint, corners bigint, area double, wkt string")


@query("udf_proxy_wards")
def proxy_wards_of_opportunities(spark: SparkSession, d: str) -> DataFrame:
    return proxy_wards(visits(spark, d), "opportunity_id", metres=500.0, most_km=75.0, least=100)


@query("src_geojson_polygons", with_views("SELECT 'State ' || left(ward_id, 7) || '_' || ward_id AS ward_id, COUNT(*) AS parts, SUM(population) AS population, MIN(col)::DOUBLE AS x0, MAX(col + 1)::DOUBLE AS x1, MIN(row)::DOUBLE AS y0, MAX(row + 1)::DOUBLE AS y1 FROM cells GROUP BY ward_id"))
def geojson_polygons(spark: SparkSession, d: str) -> DataFrame:
    """Two files of polygons with columns of their own, in web coordinates; read by name, brought to degrees, and united.

    A cell's side is `side_of` degrees, so 85 million rows of cells lie within the latitudes that web coordinates have."""
    from visitlens.sources.storage import scratch

    r, side_of, path = 6378137.0, 1e-6, scratch(spark, "boundaries")
    to_x, to_y = lambda x: r * F.radians(x), lambda y: r * F.log(F.tan(F.pi() / 4 + F.radians(y) / 2))
    corner = lambda dx, dy: F.array(to_x((F.col("col") + dx) * side_of), to_y((F.col("row") + dy) * side_of))
    ring = F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    c = cells(spark, d).withColumn("state", F.concat(F.lit("State "), F.substring("ward_id", 1, 7)))
    for name, own, rows in (("a", F.struct("state", F.col("ward_id").alias("ward"), "population"), c.where("row % 2 = 0")), ("b", F.struct("state", F.col("ward_id").alias("ward_name"), "population"), c.where("row % 2 = 1"))):
        rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), own.alias("properties"), geometry.alias("geometry"))).alias("value")).write.text(f"{path}/{name}")
    shape = "geometry struct<type: string, coordinates: array<array<array<double>>>>"
    a, b = (spark.read.json(f"{path}/{n}", schema=f"type string, properties struct<state: string, {w}: string, population: double>, {shape}").select("properties.*", F.col("geometry.coordinates")[0].alias("ring")) for n, w in (("a", "ward"), ("b", "ward_name")))
    every = a.unionByName(b, allowMissingColumns=True)
    x = lambda p: F.degrees(p[0] / r)
    y = lambda p: F.degrees(2 * F.atan(F.exp(p[1] / r)) - F.pi() / 2)
    side = lambda f, of: F.round(f(F.transform("ring", of)) / side_of, 6)
    boxes = every.select(F.concat_ws("_", "state", F.coalesce("ward", "ward_name")).alias("ward_id"), "population", side(F.array_min, x).alias("x0"), side(F.array_max, x).alias("x1"), side(F.array_min, y).alias("y0"), side(F.array_max, y).alias("y1"))
    return boxes.groupBy("ward_id").agg(F.count("*").alias("parts"), F.sum("population").alias("population"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
