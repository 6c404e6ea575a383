"""Grid cells, wards, spatial joins, clusters and routes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visitlens.functions.columns import haversine_km, ratio, sorted_list
from visitlens.operators.graph import min_label_components
from visitlens.plans.ordered import HAVERSINE_SQL
from visitlens.registry import query
from visitlens.sources.storage import saved
from visitlens.sources.views import cells, delivery_units, visits, with_views

#: Limits of the density classes, in people per square kilometre (fixed values).
LOW_DENSITY, HIGH_DENSITY = 10, 50


def density_sql(population: str = "population", metres: int = 100) -> str:
    density = f"{population} / (({metres} / 1000.0::DOUBLE) ** 2)"
    return f"CASE WHEN {density} < {LOW_DENSITY} THEN 'Low' WHEN {density} < {HIGH_DENSITY} THEN 'Medium' ELSE 'High' END"


CATEGORY_SQL = density_sql()


def density_category(population: str = "population", metres: int = 100, low: float = LOW_DENSITY, high: float = HIGH_DENSITY) -> Column:
    """The class of the people per square kilometre in square cells of so many metres."""
    density = F.col(population) / (metres / 1000.0) ** 2
    return F.when(density < low, "Low").when(density < high, "Medium").otherwise("High")


def visit_cells(v: DataFrame) -> DataFrame:
    """Visits with the row and column of the affine grid cell they are in."""
    return v.withColumns({"row": F.floor((F.col("latitude") - 9.0) / 0.0025), "col": F.floor((F.col("longitude") - 7.0) / 0.002)})


VISIT_CELLS_SQL = "vc AS (SELECT *, CAST(FLOOR((latitude - 9.0) / 0.0025) AS BIGINT) AS row, CAST(FLOOR((longitude - 7.0) / 0.002) AS BIGINT) AS col FROM visits)"


@query("scal_cell_id", with_views("SELECT row, col, 'cell_100m_' || row || '_' || col AS cell_id, 'cell_200m_' || (row // 2) || '_' || (col // 2) AS parent_id, CASE WHEN row % 2 = 0 THEN 'N' ELSE 'S' END || CASE WHEN col % 2 = 0 THEN 'W' ELSE 'E' END AS quadrant FROM cells"))
def cell_id(spark: SparkSession, d: str) -> DataFrame:
    parent = F.concat(F.lit("cell_200m_"), F.expr("row div 2"), F.lit("_"), F.expr("col div 2"))
    quadrant = F.concat(F.when(F.col("row") % 2 == 0, "N").otherwise("S"), F.when(F.col("col") % 2 == 0, "W").otherwise("E"))
    return cells(spark, d).select("row", "col", F.concat(F.lit("cell_100m_"), "row", F.lit("_"), "col").alias("cell_id"), parent.alias("parent_id"), quadrant.alias("quadrant"))


#: Finer and coarser cells, so that all classes occur: people of a cell spread over cells of these sides.
_SIDES = (100, 500, 2000)


@query("scal_density_category", with_views("SELECT row, col, " + ", ".join(f"{density_sql(metres=m)} AS category_{m}m" for m in _SIDES) + " FROM cells"))
def density_categories(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d).select("row", "col", *(density_category(metres=m).alias(f"category_{m}m") for m in _SIDES))


@query("aggr_parent_cells", with_views("SELECT row // 3 AS prow, col // 3 AS pcol, SUM(population) AS population, COUNT(*) AS children, string_agg(row || '_' || col, ',' ORDER BY row || '_' || col) AS ids FROM cells GROUP BY ALL"))
def parent_cells(spark: SparkSession, d: str) -> DataFrame:
    ids = F.array_join(F.array_sort(F.collect_list(F.concat("row", F.lit("_"), "col"))), ",")
    return cells(spark, d).groupBy(F.expr("row div 3").alias("prow"), F.expr("col div 3").alias("pcol")).agg(F.sum("population").alias("population"), F.count("*").alias("children"), ids.alias("ids"))


@query("aggr_cell_inventory", with_views("SELECT ward_id, COUNT(*) AS cells, SUM(population) AS population, COUNT(*) FILTER (WHERE population > 0) AS populated, arg_min(row || '_' || col, row(row, col)) AS first_cell FROM cells GROUP BY ward_id"))
def cell_inventory(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d).groupBy("ward_id").agg(F.count("*").alias("cells"), F.sum("population").alias("population"), F.count_if(F.col("population") > 0).alias("populated"), F.min_by(F.concat("row", F.lit("_"), "col"), F.struct("row", "col")).alias("first_cell"))


@query("join_raster_cells", with_views(VISIT_CELLS_SQL + " SELECT vc.visit_id, c.ward_id, c.population FROM vc JOIN cells c ON c.row = vc.row AND c.col = vc.col"))
def raster_cells(spark: SparkSession, d: str) -> DataFrame:
    """A spatial join turned into an equi join: points fall in the cell that the affine map gives."""
    return visit_cells(visits(spark, d)).join(cells(spark, d), ["row", "col"]).select("visit_id", "ward_id", "population")


@query("join_cells_with_visits", with_views(VISIT_CELLS_SQL + """, a AS (SELECT row, col, COUNT(*) AS n, COUNT(DISTINCT flw_id) AS flws, string_agg(DISTINCT opportunity_name, ';' ORDER BY opportunity_name) AS opps FROM vc GROUP BY row, col)
SELECT c.row, c.col, COALESCE(n, 0) AS n, COALESCE(flws, 0) AS flws, COALESCE(opps, '') AS opps FROM cells c LEFT JOIN a ON a.row = c.row AND a.col = c.col"""))
def cells_with_visits(spark: SparkSession, d: str) -> DataFrame:
    a = visit_cells(visits(spark, d)).groupBy("row", "col").agg(F.count("*").alias("n"), F.count_distinct("flw_id").alias("flws"), sorted_list("opportunity_name").alias("opps"))
    return cells(spark, d).select("row", "col").join(a, ["row", "col"], "left").fillna(0, ["n", "flws"]).fillna("", ["opps"])


@query("join_building_aggregate", with_views("""b AS (SELECT p_partkey // 50 AS row, p_partkey % 50 AS col, l_quantity AS area, l_discount AS confidence FROM lineitem JOIN part ON p_partkey = l_partkey), a AS (SELECT row, col, COUNT(*) AS n, SUM(area) AS area, AVG(confidence) AS confidence FROM b GROUP BY ALL)
SELECT c.row, c.col, COALESCE(n, 0) AS num_buildings, ROUND(COALESCE(area, 0), 4) AS total_area, ROUND(COALESCE(confidence, 0), 6) AS avg_confidence FROM cells c LEFT JOIN a ON a.row = c.row AND a.col = c.col"""))
def building_aggregate(spark: SparkSession, d: str) -> DataFrame:
    from visitlens.sources.views import table

    b = table(spark, d, "lineitem").select(F.expr("l_partkey div 50").alias("row"), (F.col("l_partkey") % 50).alias("col"), "l_quantity", "l_discount")
    a = b.groupBy("row", "col").agg(F.count("*").alias("num_buildings"), F.sum("l_quantity").alias("total_area"), F.avg("l_discount").alias("avg_confidence"))
    j = cells(spark, d).select("row", "col").join(a, ["row", "col"], "left").fillna(0)
    return j.withColumns({"total_area": F.round("total_area", 4), "avg_confidence": F.round("avg_confidence", 6)})


@query("aggr_grid_cell_tab", with_views(VISIT_CELLS_SQL + f"""
SELECT c.row, c.col, opportunity_id, COUNT(*) AS visits, ROUND(COUNT(*) / NULLIF(MAX(population), 0), 6) AS per_capita,
  ROUND(MAX(population) / 0.01::DOUBLE, 4) AS density_per_km2, {density_sql("MAX(population)")} AS density_category
FROM vc JOIN cells c ON c.row = vc.row AND c.col = vc.col GROUP BY c.row, c.col, opportunity_id"""))
def grid_cell_tab(spark: SparkSession, d: str) -> DataFrame:
    j = visit_cells(visits(spark, d)).join(cells(spark, d), ["row", "col"])
    per_cell = j.groupBy("row", "col", "opportunity_id").agg(F.count("*").alias("visits"), F.max("population").alias("population"))
    return per_cell.select(
        "row", "col", "opportunity_id", "visits", F.round(ratio("visits", "population", None), 6).alias("per_capita"), F.round(F.col("population") / 0.01, 4).alias("density_per_km2"), density_category().alias("density_category")
    )


_SPLITS = {"total": "true", "low_density": "cat = 'Low'", "medium_density": "cat = 'Medium'", "high_density": "cat = 'High'"}


def _split_sql(name: str, test: str) -> str:
    people = f"SUM(population) FILTER (WHERE {test})"
    count = f"SUM(n) FILTER (WHERE {test})"
    return f"CAST(COALESCE({count}, 0) AS BIGINT) AS {name}_visits, COUNT(*) FILTER (WHERE {test}) AS {name}_grids, COALESCE({people}, 0) AS {name}_pop, ROUND(COALESCE({count} / NULLIF({people}, 0), 0), 6) AS {name}_visits_per_pop"


@query("aggr_grid_opportunity_summary", with_views(VISIT_CELLS_SQL + f""", x AS (
  SELECT opportunity_id, c.row, c.col, MAX(population) AS population, COUNT(*) AS n FROM vc JOIN cells c ON c.row = vc.row AND c.col = vc.col GROUP BY ALL),
k AS (SELECT *, {density_sql(metres=1000)} AS cat FROM x)
SELECT opportunity_id, """ + ", ".join(_split_sql(k, t) for k, t in _SPLITS.items()) + " FROM k GROUP BY opportunity_id"))
def grid_opportunity_summary(spark: SparkSession, d: str) -> DataFrame:
    """Visits, cells, people and visits for each of them of an opportunity, in all and by density class (cells of a kilometre)."""
    j = visit_cells(visits(spark, d)).join(cells(spark, d), ["row", "col"])
    x = j.groupBy("opportunity_id", "row", "col").agg(F.max("population").alias("population"), F.count("*").alias("n")).withColumn("cat", density_category(metres=1000))
    zero = lambda c, t: F.coalesce(F.sum(F.when(F.expr(t), F.col(c))), F.lit(0))

    def split(name: str, test: str) -> list[Column]:
        return [zero("n", test).alias(f"{name}_visits"), F.count_if(F.expr(test)).alias(f"{name}_grids"), zero("population", test).cast("double").alias(f"{name}_pop"), F.round(ratio(zero("n", test), zero("population", test)), 6).alias(f"{name}_visits_per_pop")]

    return x.groupBy("opportunity_id").agg(*(c for k, t in _SPLITS.items() for c in split(k, t)))


@query("aggr_grid_sanity", with_views("SELECT (SELECT SUM(population) FROM cells) AS at_100, (SELECT SUM(p) FROM (SELECT SUM(population) AS p FROM cells GROUP BY row // 2, col // 2)) AS at_200, (SELECT SUM(p) FROM (SELECT SUM(population) AS p FROM cells GROUP BY row // 3, col // 3)) = (SELECT SUM(population) FROM cells) AS is_equal"))
def grid_sanity(spark: SparkSession, d: str) -> DataFrame:
    """Totals at each resolution must agree."""
    total = lambda s: cells(spark, d).groupBy(F.expr(f"row div {s}"), F.expr(f"col div {s}")).agg(F.sum("population").alias("p")).agg(F.sum("p").alias(f"p{s}"))
    return total(1).join(total(2)).join(total(3)).select(F.col("p1").alias("at_100"), F.col("p2").alias("at_200"), (F.col("p3") == F.col("p1")).alias("is_equal"))


@query("join_point_in_disc", with_views(f"""s AS (SELECT DISTINCT 9.0 + (n_nationkey % 5) * 0.02 AS slat, 7.0 + (n_nationkey % 7) * 0.015 AS slon, n_nationkey AS settlement FROM nation)
SELECT settlement, COUNT(*) AS visits FROM s JOIN visits ON {HAVERSINE_SQL.format(a="slat", b="latitude", c="slon", d="longitude")} <= 1.0 GROUP BY settlement"""))
def point_in_disc(spark: SparkSession, d: str) -> DataFrame:
    """Visits within a kilometre of settlements: both sides meet in grid buckets of a kilometre, then the distance decides."""
    from visitlens.sources.views import table

    key = F.col("n_nationkey").cast("bigint")
    s = table(spark, d, "nation").select(key.alias("settlement"), (9.0 + (key % 5) * 0.02).alias("slat"), (7.0 + (key % 7) * 0.015).alias("slon"))
    bucket = lambda c: F.floor(F.col(c) / 0.0095).cast("int")
    around = F.sequence(F.lit(-1), F.lit(1))
    spread = s.withColumns({"a": F.explode(F.transform(around, lambda i: bucket("slat") + i))}).withColumn("b", F.explode(F.transform(around, lambda i: bucket("slon") + i)))
    v = visits(spark, d).select("latitude", "longitude", bucket("latitude").alias("a"), bucket("longitude").alias("b"))
    near = v.join(spread, ["a", "b"]).where(haversine_km(F.col("slat"), F.col("slon"), F.col("latitude"), F.col("longitude")) <= 1.0)
    return near.groupBy("settlement").agg(F.count("*").alias("visits"))


@query("join_nearest_cell", with_views("""a AS (SELECT row, col FROM cells WHERE population = 1), b AS (SELECT row, col, population FROM cells WHERE population >= 45), x AS (SELECT a.row, a.col, b.row AS r, b.col AS c, (a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col) AS d2 FROM a, b)
SELECT row, col, arg_min(r || '_' || c, row(d2, r, c)) AS nearest, ROUND(SQRT(MIN(d2)), 4) AS distance FROM x GROUP BY row, col"""))
def nearest_cell(spark: SparkSession, d: str) -> DataFrame:
    """The nearest crowded cell of every sparse one: rings of buckets grow until the nearest is certain."""
    c = cells(spark, d)
    a, b = c.where("population = 1").select("row", "col"), c.where("population >= 45").select(F.col("row").alias("r"), F.col("col").alias("c"))
    return nearest_in_rings(a, b, width=8)


@query("join_nearest_multi_cell", with_views("""a AS (SELECT row, col FROM cells WHERE population = 1), b AS (SELECT row, col FROM cells WHERE population > 1), x AS (SELECT a.row, a.col, b.row AS r, b.col AS c, (a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col) AS d2 FROM a, b)
SELECT row, col, arg_min(r || '_' || c, row(d2, r, c)) AS nearest, ROUND(SQRT(MIN(d2)), 4) AS distance FROM x GROUP BY row, col"""))
def nearest_multi_cell(spark: SparkSession, d: str) -> DataFrame:
    """The nearest cell of more than one for every cell of one."""
    c = cells(spark, d)
    return nearest_in_rings(c.where("population = 1").select("row", "col"), c.where("population > 1").select(F.col("row").alias("r"), F.col("col").alias("c")), width=8)


def nearest_in_rings(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """a (row, col) and b (r, c): an unanswered row looks one ring of buckets further each round; a hit within the rings
    seen so far can't be beaten from outside them. What three rings don't answer goes down a pyramid of boxes, at any distance."""
    bucket = lambda x: F.floor(F.col(x) / width).cast("int")
    right = b.withColumns({"br": bucket("r"), "bc": bucket("c")})
    todo, found = a, None
    for k in (1, 3):
        span = F.sequence(F.lit(-k), F.lit(k))
        spread = todo.withColumn("br", F.explode(F.transform(span, lambda i: bucket("row") + i))).withColumn("bc", F.explode(F.transform(span, lambda i: bucket("col") + i)))
        d2 = (F.col("row") - F.col("r")) * (F.col("row") - F.col("r")) + (F.col("col") - F.col("c")) * (F.col("col") - F.col("c"))
        best = spread.join(right, ["br", "bc"]).withColumn("d2", d2).groupBy("row", "col").agg(F.min_by(F.concat("r", F.lit("_"), "c"), F.struct("d2", "r", "c")).alias("nearest"), F.min("d2").alias("d2"))
        sure = best.where(F.col("d2") <= (k * width) ** 2)
        found = sure if found is None else found.unionByName(sure)
        todo = todo.join(sure, ["row", "col"], "left_anti")
    found = found.unionByName(_nearest_down_the_pyramid(todo, b))
    return found.select("row", "col", "nearest", F.round(F.sqrt("d2"), 4).alias("distance"))


def _nearest_down_the_pyramid(a: DataFrame, b: DataFrame) -> DataFrame:
    """(row, col, nearest, d2): boxes around the places of b are opened from one over all of them down to single places;
    a row follows those boxes that may hold a place no farther than another box's farthest, so ties stay and no pair is cut."""
    r0, r1, c0, c1 = b.agg(F.min("r"), F.max("r"), F.min("c"), F.max("c")).first()
    size = 4
    while r0 is not None and size <= max(r1 - r0, c1 - c0):
        size *= 4
    d2 = lambda dr, dc: dr * dr + dc * dc
    gap = lambda x, low, high: F.greatest(F.col(low) - F.col(x), F.col(x) - F.col(high), F.lit(0))
    reach = lambda x, low, high: F.greatest(F.abs(F.col(x) - F.col(low)), F.abs(F.col(x) - F.col(high)))
    places, each = b.distinct(), Window.partitionBy("row", "col")
    state = a.withColumns({"pr": F.lit(0).cast("bigint"), "pc": F.lit(0).cast("bigint")})
    while size > 1:
        size //= 4
        at = lambda x, low, s: F.floor((F.col(x) - F.lit(low)) / s)
        boxes = places.groupBy(at("r", r0, size).alias("br"), at("c", c0, size).alias("bc"), at("r", r0, size * 4).alias("pr"), at("c", c0, size * 4).alias("pc")).agg(F.min("r").alias("top"), F.max("r").alias("bottom"), F.min("c").alias("left"), F.max("c").alias("right"))
        opened = state.join(boxes, ["pr", "pc"]).withColumns({"near": d2(gap("row", "top", "bottom"), gap("col", "left", "right")), "far": d2(reach("row", "top", "bottom"), reach("col", "left", "right"))})
        kept = opened.withColumn("bound", F.min("far").over(each)).where("near <= bound")
        state = kept.select("row", "col", F.col("br").alias("pr"), F.col("bc").alias("pc"), F.col("top").alias("r"), F.col("left").alias("c"), F.col("near").alias("d2")) if size == 1 else kept.select("row", "col", F.col("br").alias("pr"), F.col("bc").alias("pc"))
    return state.groupBy("row", "col").agg(F.min_by(F.concat("r", F.lit("_"), "c"), F.struct("d2", "r", "c")).alias("nearest"), F.min("d2").alias("d2"))


@query("cell_components", "WITH RECURSIVE " + with_views("""c AS (SELECT ward_id, row, col, row * 50 + col AS id FROM cells WHERE population > 0), e AS (SELECT a.id AS u, b.id AS v FROM c a JOIN c b ON a.ward_id = b.ward_id AND ABS(a.row - b.row) + ABS(a.col - b.col) = 1),
r AS (SELECT id, id AS root FROM c UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.id) SELECT id, MIN(root) AS component FROM r GROUP BY id""").removeprefix("WITH "))
def cell_components(spark: SparkSession, d: str) -> DataFrame:
    """Connected populated cells of a ward, four neighbours each."""
    c = cells(spark, d).where("population > 0").select("ward_id", "row", "col", (F.col("row") * 50 + F.col("col")).alias("id"))
    step = F.explode(F.array(F.struct(F.lit(0).alias("dr"), F.lit(1).alias("dc")), F.struct(F.lit(1).alias("dr"), F.lit(0).alias("dc"))))
    to = c.select("ward_id", F.col("id").alias("u"), "row", "col", step.alias("s")).select("ward_id", "u", (F.col("row") + F.col("s.dr")).alias("row"), (F.col("col") + F.col("s.dc")).alias("col"))
    edges = to.join(c, ["ward_id", "row", "col"]).select("u", F.col("id").alias("v"))
    return min_label_components(c.select("id"), edges)


_CENTRE_SQL = "COALESCE(SUM({c} * population) / NULLIF(SUM(population), 0), AVG({c}))"


@query("aggr_cell_clusters", "WITH RECURSIVE " + with_views(VISIT_CELLS_SQL + f""", c AS (SELECT ward_id, row, col, row * 50 + col AS id, population, 9.0::DOUBLE + (row + 0.5) * 0.0025::DOUBLE AS lat, 7.0::DOUBLE + (col + 0.5) * 0.002::DOUBLE AS lon FROM cells WHERE population > 10),
e AS (SELECT a.id AS u, b.id AS v FROM c a JOIN c b ON a.ward_id = b.ward_id AND ABS(a.row - b.row) + ABS(a.col - b.col) = 1), r AS (SELECT id, id AS root FROM c UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.id),
l AS (SELECT id, MIN(root) AS component FROM r GROUP BY id), n AS (SELECT row, col, COUNT(*) AS n FROM vc GROUP BY ALL)
SELECT ward_id || '_cluster_' || ROW_NUMBER() OVER (PARTITION BY ward_id ORDER BY component) AS cluster_id, ward_id, COUNT(*) AS cells, SUM(population) AS population, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS visits,
  MIN(c.row) AS min_row, MAX(c.row) AS max_row, MIN(c.col) AS min_col, MAX(c.col) AS max_col, ROUND({_CENTRE_SQL.format(c="lat")}, 7) AS latitude, ROUND({_CENTRE_SQL.format(c="lon")}, 7) AS longitude
FROM c JOIN l ON l.id = c.id LEFT JOIN n ON n.row = c.row AND n.col = c.col GROUP BY ward_id, component""").removeprefix("WITH "))
def cell_clusters(spark: SparkSession, d: str) -> DataFrame:
    """A ward's clusters of peopled cells whose sides touch, numbered as a scan by rows meets them, with their extent and the centre
    of their people."""
    c = cells(spark, d).where("population > 10").withColumns({"id": F.col("row") * 50 + F.col("col"), "lat": 9.0 + (F.col("row") + 0.5) * 0.0025, "lon": 7.0 + (F.col("col") + 0.5) * 0.002})
    step = F.explode(F.array(F.struct(F.lit(0).alias("r"), F.lit(1).alias("c")), F.struct(F.lit(1).alias("r"), F.lit(0).alias("c"))))
    to = c.select("ward_id", F.col("id").alias("u"), "row", "col", step.alias("s")).select("ward_id", "u", (F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"))
    labels = min_label_components(c.select("id"), to.join(c, ["ward_id", "row", "col"]).select("u", F.col("id").alias("v")))
    n = visit_cells(visits(spark, d)).groupBy("row", "col").agg(F.count("*").alias("n"))
    centre = lambda x: F.round(F.coalesce(F.sum(F.col(x) * F.col("population")) / F.nullif(F.sum("population"), F.lit(0.0)), F.avg(x)), 7)
    g = c.join(labels, "id").join(n, ["row", "col"], "left").groupBy("ward_id", "component").agg(
        F.count("*").alias("cells"), F.sum("population").alias("population"), F.coalesce(F.sum("n"), F.lit(0)).alias("visits"), F.min("row").alias("min_row"), F.max("row").alias("max_row"), F.min("col").alias("min_col"), F.max("col").alias("max_col"),
        centre("lat").alias("latitude"), centre("lon").alias("longitude"),
    )
    number = F.row_number().over(Window.partitionBy("ward_id").orderBy("component"))
    return g.withColumn("cluster_id", F.concat("ward_id", F.lit("_cluster_"), number)).drop("component")


def grown_clusters(points: DataFrame, reach: int, least: int) -> DataFrame:
    """(id, cluster) of points (id, x, y, whole numbers): single-link clusters of points no farther apart than `reach`, named by
    their least id; clusters of under `least` points are none. Neighbours come from grid buckets, equal places meet only once."""
    places = saved(points.groupBy("x", "y").agg(F.min("id").alias("place"), F.count("*").alias("n")), "places")
    bucket = lambda c: F.floor(F.col(c) / reach)
    around = F.sequence(F.lit(-1), F.lit(1))
    spread = places.select("place", "x", "y", F.explode(F.transform(around, lambda i: bucket("x") + i)).alias("a")).withColumn("b", F.explode(F.transform(around, lambda i: bucket("y") + i)))
    other = places.select(F.col("place").alias("v"), F.col("x").alias("x2"), F.col("y").alias("y2"), bucket("x").alias("a"), bucket("y").alias("b"))
    d2 = (F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")) + (F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2"))
    edges = spread.join(other, ["a", "b"]).where((d2 <= reach * reach) & (F.col("place") < F.col("v"))).select(F.col("place").alias("u"), "v")
    labels = min_label_components(places.select(F.col("place").alias("id")), edges).withColumnRenamed("id", "place")
    named = places.join(labels, "place")
    sizes = named.groupBy("component").agg(F.sum("n").alias("size"))
    cluster = F.when(F.col("size") >= least, F.col("component")).alias("cluster")
    return points.select("id", "x", "y").join(named.join(sizes, "component"), ["x", "y"]).select("id", cluster)


@query("cluster_growth")
def cluster_growth(spark: SparkSession, d: str) -> DataFrame:
    """All visits by their places, in steps of a ten-thousandth of a degree; places ten steps apart are linked."""
    step = lambda c, start: F.round((F.col(c) - start) * 10_000).cast("bigint")
    return grown_clusters(visits(spark, d).select(F.col("visit_id").alias("id"), step("latitude", 9.0).alias("x"), step("longitude", 7.0).alias("y")), reach=10, least=3)


@query("scal_wkt_centroid", with_views("SELECT row, col, ROUND((col + 0.5)::DOUBLE, 4) AS x, ROUND((row + 0.5)::DOUBLE, 4) AS y FROM cells"))
def wkt_centroid(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the first four vertices of a polygon in text form."""
    corner = lambda dx, dy: F.concat((F.col("col") + dx).cast("string"), F.lit(" "), (F.col("row") + dy).cast("string"))
    wkt = F.concat(F.lit("POLYGON (("), F.concat_ws(", ", corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0)), F.lit("))"))
    pairs = F.slice(F.split(F.regexp_replace("wkt", r"POLYGON \(\(|\)\)", ""), ", "), 1, 4)
    mean = lambda i: F.round(F.aggregate(F.transform(pairs, lambda p: F.split_part(p, F.lit(" "), F.lit(i)).cast("double")), F.lit(0.0), lambda a, x: a + x) / 4, 4)
    return cells(spark, d).withColumn("wkt", wkt).select("row", "col", mean(1).alias("x"), mean(2).alias("y"))


@query("scal_haversine", with_views(f"SELECT visit_id, ROUND({HAVERSINE_SQL.format(a='9.05', b='latitude', c='7.05', d='longitude')}, 6) AS km FROM visits"))
def haversine(spark: SparkSession, d: str) -> DataFrame:
    return visits(spark, d).select("visit_id", F.round(haversine_km(F.lit(9.05), F.lit(7.05), F.col("latitude"), F.col("longitude")), 6).alias("km"))


@query("scal_web_mercator", with_views("SELECT visit_id, ROUND(6378137.0 * radians(longitude), 3) AS x, ROUND(6378137.0 * ln(tan(pi() / 4 + radians(latitude) / 2)), 3) AS y FROM visits"))
def web_mercator(spark: SparkSession, d: str) -> DataFrame:
    r = 6378137.0
    return visits(spark, d).select("visit_id", F.round(r * F.radians("longitude"), 3).alias("x"), F.round(r * F.log(F.tan(F.pi() / 4 + F.radians("latitude") / 2)), 3).alias("y"))


def hull_of_rows(points: list) -> list:
    """Convex hull of (x, y) rows by monotone chains, counter-clockwise from the lowest x."""
    p = sorted({tuple(q) for q in points})
    if len(p) < 3:
        return p

    def chain(ps):
        out: list = []
        for q in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    return chain(p) + chain(p[::-1])


def hull(points: np.ndarray) -> np.ndarray:
    """The same of an array."""
    return np.array(hull_of_rows(points.tolist())) if len(points) else np.unique(points, axis=0)


def area_of_ring(ring: list) -> float:
    return abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(ring, [*ring[1:], ring[0]], strict=True))) / 2


@query("udf_convex_hull")
def convex_hull(spark: SparkSession, d: str) -> DataFrame:
    """Each worker's reach. Of the places of one latitude only the two outer ones can be corners, which partial sums find before
    anything is sent; slices of a worker's latitudes send their corners on, and the hull of these is the worker's.
    Visits without a place are left out."""

    def corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [hull_of_rows(r) for r in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(found, pa.list_(pa.list_(pa.float64())))], names=["flw_id", "corners"])

    def outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hulls = [hull_of_rows(r) for r in b.column(1).to_pylist()]
            areas = [round(area_of_ring(h), 9) for h in hulls]
            texts = ["POLYGON ((" + ", ".join(f"{x:g} {y:g}" for x, y in [*h, h[0]]) + "))" for h in hulls]
            yield pa.record_batch([b.column(0), pa.array([len(h) for h in hulls], pa.int64()), pa.array(areas, pa.float64()), pa.array(texts)], names=["flw_id", "n_corners", "area", "wkt"])

    sides = visits(spark, d).where("latitude IS NOT NULL AND longitude IS NOT NULL").groupBy("flw_id", "latitude").agg(F.min("longitude").alias("west"), F.max("longitude").alias("east"))
    point = lambda x: F.array(F.col(x), F.col("latitude"))
    slices = sides.groupBy("flw_id", F.floor(F.col("latitude") * 10).alias("slice")).agg(F.flatten(F.collect_list(F.array(point("west"), point("east")))).alias("points"))
    few = slices.select("flw_id", "points").mapInArrow(corners, "flw_id bigint, corners array<array<double>>")
    return few.groupBy("flw_id").agg(F.flatten(F.collect_list("corners")).alias("corners")).mapInArrow(outlines, "flw_id bigint, n_corners bigint, area double, wkt string")


@query("udf_nearest_neighbour_tour")
def nearest_neighbour_tour(spark: SparkSession, d: str) -> DataFrame:
    """Greedy tour of a worker's day: always on to the nearest place not yet seen, from the first one in time."""

    def length(p: np.ndarray) -> float:
        left, at, km = np.ones(len(p), bool), 0, 0.0
        left[0] = False
        while left.any():
            a = np.sin((p[:, 0] - p[at, 0]) / 2) ** 2 + np.cos(p[at, 0]) * np.cos(p[:, 0]) * np.sin((p[:, 1] - p[at, 1]) / 2) ** 2
            far = np.where(left, 2 * 6371.0 * np.arcsin(np.sqrt(a)), np.inf)
            at = int(far.argmin())
            km += far[at]
            left[at] = False
        return round(km, 5)

    def tours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            km = [length(np.radians(np.stack([np.array([q[k] for q in p]) for k in ("latitude", "longitude")], 1))) for p in b["places"]]
            yield pd.DataFrame({"flw_id": b["flw_id"], "visit_day": b["visit_day"], "stops": [len(p) for p in b["places"]], "km": km})

    place = F.struct("visit_date", "visit_id", "latitude", "longitude")
    days = visits(spark, d).groupBy("flw_id", "visit_day").agg(F.sort_array(F.collect_list(place)).alias("places"))
    return days.mapInPandas(tours, "flw_id bigint, visit_day date, stops bigint, km double")


@query("udf_seed_radius_clusters")
def seed_radius_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Greedy balls around the first point not yet taken, per worker; balls of under three points release theirs."""

    return ball_clusters(visits(spark, d).select("flw_id", "visit_id", "latitude", "longitude"), km=1.0, least=3)


def balls_of_groups(start: np.ndarray, place: np.ndarray, first: np.ndarray, n: np.ndarray, km: float, least: int, most: int = 1 << 22) -> np.ndarray:
    """The first visit of the ball that takes each place (degrees), or -1. Rows are sorted by group and first visit; start marks
    a group's first row. Candidates for a ball stand in the grid cells around its centre; `most` of them, or those of
    one place, are compared at a time."""
    group, heads, p = np.cumsum(start) - 1, np.flatnonzero(start), np.radians(place)
    lat, lon = np.nan_to_num(place).T
    reach = np.sin(km / 6371.0) / np.maximum(np.cos(np.radians(np.maximum.reduceat(np.abs(lat), heads))), 1e-9)
    wide = np.where(reach < 1, np.degrees(np.arcsin(np.minimum(reach, 1))) * 1.001, 1000.0)
    wide = np.where(np.maximum.reduceat(lon, heads) - np.minimum.reduceat(lon, heads) > 180, 1000.0, wide)  # balls may reach over the end of the longitudes
    cell = lambda x: np.clip(np.floor(x), -(1 << 30), 1 << 30).astype(np.int64)
    rows_of_cells, row = np.unique((group << 32) + cell(lat / (km / 110.0)), return_inverse=True)
    column = cell(lon / wide[group])
    span, column = int(column.max() - column.min()) + 4, column - column.min() + 2
    key = row * span + column
    order = np.argsort(key, kind="stable")
    begin, count = [], []
    for step in (-1, 0, 1):
        other = np.searchsorted(rows_of_cells, rows_of_cells + step)
        there = np.append(rows_of_cells, np.iinfo(np.int64).max)[other] == rows_of_cells + step
        low, high = (np.searchsorted(key[order], other[row] * span + column + x, side=side) for x, side in ((-1, "left"), (1, "right")))
        begin.append(low)
        count.append(np.where(there[row], high - low, 0))
    begin, count = np.stack(begin, 1), np.stack(count, 1)
    total = np.cumsum(count.sum(1))
    cluster, at = np.full(len(place), -1, np.int64), 0
    while at < len(place):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        rows = at + np.flatnonzero(cluster[at:stop] < 0)
        at = stop
        size = count[rows].ravel()
        i = np.repeat(rows, count[rows].sum(1))
        j = order[np.arange(len(i)) + np.repeat(begin[rows].ravel() - np.cumsum(size) + size, size)]
        a = np.sin((p[j, 0] - p[i, 0]) / 2) ** 2 + np.cos(p[i, 0]) * np.cos(p[j, 0]) * np.sin((p[j, 1] - p[i, 1]) / 2) ** 2
        near = (2 * 6371.0 * np.arcsin(np.sqrt(a)) <= km) & (cluster[j] < 0)
        i, j = i[near], j[near]
        rows = rows[np.bincount(i, n[j], len(place))[rows] >= least]  # later there can only be fewer
        for r, x, y in zip(rows.tolist(), np.searchsorted(i, rows).tolist(), np.searchsorted(i, rows, side="right").tolist(), strict=True):
            if cluster[r] < 0:
                own = j[x:y]
                own = own[cluster[own] < 0]
                if n[own].sum() >= least:
                    cluster[own] = first[r]
    return cluster


def ball_clusters(v: DataFrame, km: float, least: int, most: int = 20_000) -> DataFrame:
    """(flw_id, visit_id, cluster): cluster is the number of the visit whose ball took this one, or -1. Visits without a worker
    or a place are left out.

    Places are what a worker's visits have in common: each with its number of visits and its first one. A task gets whole workers,
    one after the other, with their places in the order of their first visits; the result goes back to the visits by a join.
    Balls only reach from place to place within `km`, so the places of a worker with more than `most` are split before, into
    components of grid cells that touch.
    """
    v = v.where("flw_id IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL")
    places = saved(v.groupBy("flw_id", "latitude", "longitude").agg(F.min("visit_id").alias("first"), F.count("*").alias("n")).where("first IS NOT NULL"), "places")
    far = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.lit(km / 6371.0)) / F.cos(F.radians(F.max(F.abs("latitude")))))))
    large = saved(places.groupBy("flw_id").agg(F.count("*").alias("places"), (far * 1.001).alias("wide")).where(F.col("places") > most).drop("places"), "large")

    def answer(t: pa.Table) -> pa.RecordBatch:
        flw, part, first, n, lat, lon = (t.column(k).to_numpy() for k in ("flw_id", "part", "first", "n", "latitude", "longitude"))
        start = np.concatenate([[True], (flw[1:] != flw[:-1]) | (part[1:] != part[:-1])])
        cluster = balls_of_groups(start, np.stack([lat, lon], 1), first, n, km, least)
        return pa.record_batch([pa.array(x) for x in (flw, lat, lon, cluster)], names=["flw_id", "latitude", "longitude", "cluster"])

    def balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the last group, which may go on in the next batch
        for b in batches:
            flw, part = b.column("flw_id").to_numpy(), b.column("part").to_numpy()
            cut = int(np.count_nonzero((flw != flw[-1:]) | (part != part[-1:])))
            fresh = held and b.num_rows and (held[-1].column("flw_id")[-1].as_py(), held[-1].column("part")[-1].as_py()) != (flw[-1], part[-1])
            if cut or fresh:
                yield answer(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = []
            if b.num_rows:
                held.append(b.slice(cut))
        if held:
            yield answer(pa.Table.from_batches(held))

    def taken(df: DataFrame) -> DataFrame:
        ordered = df.repartition("flw_id", "part").sortWithinPartitions("flw_id", "part", "first", "latitude", "longitude")
        return ordered.select("flw_id", "part", "first", "n", "latitude", "longitude").mapInArrow(balls, "flw_id bigint, latitude double, longitude double, cluster bigint")

    whole = F.lit(0).cast("bigint")
    if large.isEmpty():
        found = taken(places.withColumn("part", whole))
    else:
        found = taken(places.join(large, "flw_id", "left_anti").withColumn("part", whole)).unionByName(taken(_in_components(places.join(large, "flw_id"), km)))
    return v.join(found, ["flw_id", "latitude", "longitude"]).select("flw_id", "visit_id", "cluster")


def _in_components(places: DataFrame, km: float) -> DataFrame:
    """places with the component (part) of touching grid cells that each lies in; cells are no smaller than a ball's reach, which
    is `wide` degrees of longitude."""
    cell = places.withColumns({"a": F.floor(F.col("latitude") / (km / 110.0)), "b": F.floor(F.col("longitude") / F.col("wide"))})
    cells_ = saved(cell.groupBy("flw_id", "a", "b").agg(F.min("first").alias("id")), "cells")
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1))))
    to = cells_.select("flw_id", F.col("id").alias("u"), "a", "b", F.explode(steps).alias("s")).select("flw_id", "u", (F.col("a") + F.col("s.i")).alias("a"), (F.col("b") + F.col("s.j")).alias("b"))
    labels = min_label_components(cells_.select("id"), to.join(cells_, ["flw_id", "a", "b"]).select("u", F.col("id").alias("v")))
    return cell.join(cells_, ["flw_id", "a", "b"]).join(labels, "id").withColumnRenamed("component", "part")


@query("aggr_cluster_details", with_views("SELECT service_area_id, COUNT(*) AS n, ROUND(AVG(buildings), 6) AS mean_buildings, MIN(du_name) AS first_du, MAX(du_name) AS last_du, ROUND(100.0 * COUNT(*) FILTER (WHERE buildings = 1) / COUNT(*), 4) AS single_pct, ROUND(100.0 * COUNT(*) FILTER (WHERE buildings <= 5) / COUNT(*), 4) AS upto_five_pct FROM dus GROUP BY service_area_id"))
def cluster_details(spark: SparkSession, d: str) -> DataFrame:
    share = lambda c: F.round(100.0 * F.count_if(c) / F.count("*"), 4)
    return delivery_units(spark, d).groupBy("service_area_id").agg(
        F.count("*").alias("n"), F.round(F.avg("buildings"), 6).alias("mean_buildings"), F.min("du_name").alias("first_du"), F.max("du_name").alias("last_du"), share(F.col("buildings") == 1).alias("single_pct"), share(F.col("buildings") <= 5).alias("upto_five_pct")
    )


@query("aggr_large_first_order", with_views("SELECT flw_id, COALESCE(MAX(CASE WHEN buildings >= 5 THEN du_name END) < MIN(CASE WHEN buildings < 5 THEN du_name END), true) AS large_first FROM dus GROUP BY flw_id"))
def large_first_order(spark: SparkSession, d: str) -> DataFrame:
    """Whether a worker's large units all come before the small ones."""
    large, small = F.max(F.when(F.col("buildings") >= 5, F.col("du_name"))), F.min(F.when(F.col("buildings") < 5, F.col("du_name")))
    return delivery_units(spark, d).groupBy("flw_id").agg(F.coalesce(large < small, F.lit(True)).alias("large_first"))
