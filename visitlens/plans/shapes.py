"""Rasters and polygons as files and as shapes: scans of both, regions of equal cells, unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.operators.graph import min_label_components
from visitlens.operators.overlay import signed_area, union_edges
from visitlens.operators.rings import region_edges, ring_text, rings
from visitlens.plans.further import RADIUS, WARDS_SQL, ward_polygons
from visitlens.registry import query
from visitlens.sources import tiff
from visitlens.sources.shapefile import ShapefileSource
from visitlens.sources.storage import scratch
from visitlens.sources.views import cells, with_views

DX, DY, WEST, SOUTH = 0.002, 0.0025, 7.0, 9.0


def raster_files(spark: SparkSession, d: str, block: int = 16, strip: int = 4) -> str:
    """The population of the cells as a mosaic of GeoTIFF files in the shared folder; its path."""
    tiff.register(spark)
    path = scratch(spark, "raster")
    c = cells(spark, d).select("row", "col", F.col("population").alias("value"))
    dealt = c.repartition(F.expr(f"row div {block}"), F.expr(f"col div {block}"))
    options = {"path": path, "block": block, "strip": strip, "x": WEST, "y": SOUTH, "dx": DX, "dy": -DY, "nodata": -99999}
    dealt.write.format("tiff").options(**options).mode("append").save()
    return path


_CENTRES = "ROUND(7.0::DOUBLE + (col + 0.5) * 0.002::DOUBLE, 6) AS longitude, ROUND(9.0::DOUBLE + (row + 0.5) * 0.0025::DOUBLE, 6) AS latitude"


@query("src_raster_scan", with_views(f"SELECT row, col, {_CENTRES}, population FROM cells WHERE population > 0"))
def raster_scan(spark: SparkSession, d: str) -> DataFrame:
    """A population raster read from its files, many small ones in a task: peopled pixels and their centres."""
    r = spark.read.format("tiff").load(raster_files(spark, d))
    return r.where("value > 0").select("row", "col", F.round("x", 6).alias("longitude"), F.round("y", 6).alias("latitude"), F.col("value").alias("population"))


@query("src_raster_rows", with_views("""SELECT row, COUNT(*) AS pixels, SUM(population) AS population FROM cells
WHERE row BETWEEN 3 AND 17 AND col < 20 GROUP BY row"""))
def raster_rows(spark: SparkSession, d: str) -> DataFrame:
    """Totals of a window of the raster: only the strips that meet it are planned."""
    r = spark.read.format("tiff").option("bytes", 1).load(raster_files(spark, d))
    return r.where("row >= 3 AND row <= 17 AND col < 20").groupBy("row").agg(F.count("*").alias("pixels"), F.sum("value").alias("population"))


_CLASSES = "CASE WHEN population >= 35 THEN 3 WHEN population >= 20 THEN 2 ELSE 1 END"
#: Components of equal cells, and what stands around each corner of a cell.
_REGIONS_SQL = f"""c AS (SELECT row, col, row * 50 + col AS id, {_CLASSES} AS class, population FROM cells),
e AS (SELECT a.id AS u, b.id AS v FROM c a JOIN c b ON a.class = b.class AND ABS(a.row - b.row) + ABS(a.col - b.col) = 1),
r AS (SELECT id, id AS root FROM c UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.id),
l AS (SELECT id, MIN(root) AS region FROM r GROUP BY id),
k AS (SELECT region, row + dr AS y, col + dc AS x, COUNT(*) AS n, COUNT(DISTINCT (dr + dc) % 2) AS kinds
  FROM l JOIN c ON c.id = l.id, (VALUES (0), (1)) v(dr), (VALUES (0), (1)) w(dc) GROUP BY ALL),
t AS (SELECT region, COUNT(*) FILTER (WHERE n = 1) AS one, COUNT(*) FILTER (WHERE n = 3) AS three, COUNT(*) FILTER (WHERE n = 2 AND kinds = 1) AS across
  FROM k GROUP BY region),
s AS (SELECT region, MIN(class) AS class, COUNT(*) AS pixels, SUM(population) AS population, AVG(col + 0.5) AS x, AVG(row + 0.5) AS y
  FROM l JOIN c ON c.id = l.id GROUP BY region),
j AS (SELECT region, COUNT(*) AS joints FROM l JOIN e ON e.u = l.id GROUP BY region)"""


def cell_regions(spark: SparkSession, d: str) -> DataFrame:
    """(region, class, row, col, population): cells in regions of one class whose sides touch, named by the least cell."""
    c = cells(spark, d).select("row", "col", "population", F.expr(_CLASSES).alias("class"), (F.col("row") * 50 + F.col("col")).alias("id"))
    step = F.explode(F.array(F.struct(F.lit(0).alias("r"), F.lit(1).alias("c")), F.struct(F.lit(1).alias("r"), F.lit(0).alias("c"))))
    to = c.select("class", F.col("id").alias("u"), "row", "col", step.alias("s")).select("class", "u", (F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"))
    labels = min_label_components(c.select("id"), to.join(c, ["class", "row", "col"]).select("u", F.col("id").alias("v")))
    return c.join(labels, "id").withColumnRenamed("component", "region").drop("id")


@query("aggr_raster_regions", "WITH RECURSIVE " + with_views(_REGIONS_SQL + """
SELECT s.region, class, pixels, population, ROUND(x, 6) AS x, ROUND(y, 6) AS y, pixels::DOUBLE AS area, (4 * pixels - COALESCE(joints, 0))::DOUBLE AS length,
  one + three + 2 * across AS corners, 1 - (one - three + 2 * across) // 4 AS holes
FROM s JOIN t ON t.region = s.region LEFT JOIN j ON j.region = s.region""").removeprefix("WITH "))
def raster_regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions of cells of one class as polygons: area, length of the outline, corners and holes, from the traced rings."""
    r = cell_regions(spark, d)
    traced = rings(region_edges(r), "region")
    shape = traced.groupBy("region").agg(
        F.round(F.sum("area"), 6).alias("area"), F.round(F.sum("length"), 6).alias("length"), F.sum("corners").alias("corners"), F.count_if(F.col("area") < 0).alias("holes")
    )
    own = r.groupBy("region").agg(
        F.min("class").alias("class"), F.count("*").alias("pixels"), F.sum("population").alias("population"), F.round(F.avg(F.col("col") + 0.5), 6).alias("x"), F.round(F.avg(F.col("row") + 0.5), 6).alias("y")
    )
    return own.join(shape, "region")


#: Overlapping whole-number rectangles of each ward, one of each cell.
_BOXES = {"x0": "2 * col - population % 3", "x1": "2 * col + 2 + population % 4", "y0": "2 * row - population % 2", "y1": "2 * row + 2 + population % 5"}
_BOXES_SQL = "b AS (SELECT ward_id, " + ", ".join(f"CAST({v} AS BIGINT) AS {k}" for k, v in _BOXES.items()) + """ FROM cells),
u AS (SELECT DISTINCT ward_id, x, y FROM (SELECT ward_id, y0, y1, UNNEST(range(x0, x1)) AS x FROM b), LATERAL (SELECT UNNEST(range(y0, y1)) AS y)),
k AS (SELECT ward_id, y + dr AS y, x + dc AS x, COUNT(*) AS n, COUNT(DISTINCT (dr + dc + 2) % 2) AS kinds FROM u, (VALUES (0), (1)) v(dr), (VALUES (0), (1)) w(dc) GROUP BY ALL),
t AS (SELECT ward_id, COUNT(*) FILTER (WHERE n = 1) AS one, COUNT(*) FILTER (WHERE n = 3) AS three, COUNT(*) FILTER (WHERE n = 2 AND kinds = 1) AS across FROM k GROUP BY ward_id),
j AS (SELECT a.ward_id, COUNT(*) AS joints FROM u a JOIN u b ON a.ward_id = b.ward_id AND (b.x = a.x + 1 AND b.y = a.y OR b.x = a.x AND b.y = a.y + 1) GROUP BY a.ward_id),
s AS (SELECT ward_id, COUNT(*) AS area FROM u GROUP BY ward_id)"""


def united(polygons: DataFrame, key: str, size: float, grain: float = 1e-9) -> DataFrame:
    """(key, area, length, corners, parts, holes, wkt) of the union of each key's polygons (key, polygon, xs, ys)."""
    r = rings(union_edges(polygons, key, size, grain), key)
    outer = F.col("area") > 0
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ring", ring_text(F.col("xs"), F.col("ys")).alias("t")))), lambda v: v["t"]), ", ")
    return r.groupBy(key).agg(
        F.sum("area").alias("area"), F.sum("length").alias("length"), F.sum("corners").alias("corners"), F.count_if(outer).alias("parts"), F.count_if(~outer).alias("holes"), text.alias("rings")
    )


@query("aggr_polygon_union", with_views(_BOXES_SQL + """
SELECT s.ward_id, area::DOUBLE AS area, (4 * area - 2 * COALESCE(joints, 0))::DOUBLE AS length, one + three + 2 * across AS corners,
  (one - three + 2 * across) // 4 AS parts_less_holes
FROM s JOIN t ON t.ward_id = s.ward_id LEFT JOIN j ON j.ward_id = s.ward_id"""))
def polygon_union(spark: SparkSession, d: str) -> DataFrame:
    """The union of a ward's overlapping rectangles, by its outline."""
    x0, x1, y0, y1 = (F.expr(f"CAST({_BOXES[k]} AS DOUBLE)") for k in ("x0", "x1", "y0", "y1"))
    boxes = cells(spark, d).select("ward_id", (F.col("row") * 50 + F.col("col")).alias("polygon"), F.array(x0, x1, x1, x0).alias("xs"), F.array(y0, y0, y1, y1).alias("ys"))
    u = united(boxes, "ward_id", size=8.0)
    return u.select("ward_id", F.round("area", 6).alias("area"), F.round("length", 6).alias("length"), "corners", (F.col("parts") - F.col("holes")).alias("parts_less_holes"))


_SHAPE_SQL = """p AS (SELECT ward_id, population, CAST(population AS INT) % 3 AS kind, col * 3 AS x, row * 3 AS y, row, col FROM cells)"""


def shape_rings() -> Column:
    """Polygons of a cell by its population modulo 3: a square; one with a hole; two, one of them with a hole."""
    at = lambda c, vs: F.array(*((F.col(c) * 3 + v).cast("double") for v in vs))
    ring = lambda hole, xs, ys: F.struct(F.lit(hole).alias("hole"), at("col", xs).alias("xs"), at("row", ys).alias("ys"))
    square, hole, far = ring(False, (0, 0, 2, 2), (0, 2, 2, 0)), ring(True, (0.5, 1, 1, 0.5), (0.5, 0.5, 1.5, 1)), ring(False, (2.25, 2.25, 2.75), (0, 1, 0.5))
    kind = F.col("population").cast("int") % 3
    return F.when(kind == 0, F.array(square)).when(kind == 1, F.array(square, hole)).otherwise(F.array(far, square, hole))


@query("src_shapefile_scan", with_views(_SHAPE_SQL + """ SELECT ward_id, row, col, population, 'Ward ' || ward_id AS name, 4::DOUBLE - CASE WHEN kind = 0 THEN 0 ELSE 0.375 END + CASE WHEN kind = 2 THEN 0.25 ELSE 0 END AS area,
  (4 + CASE WHEN kind = 0 THEN 0 ELSE 4 END + CASE WHEN kind = 2 THEN 3 ELSE 0 END)::BIGINT AS corners, CASE WHEN kind = 2 THEN 2 ELSE 1 END::BIGINT AS parts, CASE WHEN kind = 0 THEN 0 ELSE 1 END::BIGINT AS holes, CASE WHEN kind = 2 THEN 1 WHEN kind = 1 THEN 0 END AS part_with_hole FROM p"""))
def shapefile_scan(spark: SparkSession, d: str) -> DataFrame:
    """Polygons written as shapefiles and scanned back in parts, with their attributes: area, corners, parts and holes of each."""
    spark.dataSource.register(ShapefileSource)
    path = scratch(spark, "shapes")
    name = F.concat(F.lit("Ward "), "ward_id").alias("name")
    cells(spark, d).select("ward_id", "row", "col", "population", name, shape_rings().alias("rings")).write.format("shapefile").option("path", path).mode("append").save()
    s = spark.read.format("shapefile").load(path)
    areas = F.transform("rings", lambda r: -signed_area(r["xs"], r["ys"]))  # outer rings turn clockwise
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    holes = F.filter("rings", lambda r: r["hole"])
    return s.select(
        "ward_id", "row", "col", "population", "name", F.round(total(areas), 6).alias("area"), F.aggregate(F.transform("rings", lambda r: F.size(r["xs"])), F.lit(0), lambda a, n: a + n).cast("bigint").alias("corners"),
        (F.size("rings") - F.size(holes)).cast("bigint").alias("parts"), F.size(holes).cast("bigint").alias("holes"), F.array_max(F.transform(holes, lambda r: r["part"])).alias("part_with_hole"),
    )


@query("aggr_ward_union", "WITH " + WARDS_SQL + f""", c AS (SELECT DISTINCT ward % 4 AS ward_row, cx FROM wards),
n AS (SELECT ward_row, COUNT(*) AS n FROM c GROUP BY ward_row), o AS (SELECT {RADIUS}::DOUBLE AS r, 2 * {RADIUS}::DOUBLE - 0.02::DOUBLE AS over)
SELECT ward_row, ROUND(n * 2 * r * r - (n - 1) * over * over / 2, 9) AS area, ROUND(n * 4 * sqrt(2) * r - (n - 1) * 4 * over / sqrt(2), 7) AS length,
  CAST(4 * n AS BIGINT) AS corners, 1::BIGINT AS parts, 0::BIGINT AS holes FROM n, o""")
def ward_union(spark: SparkSession, d: str) -> DataFrame:
    """Wards (slanting squares) that stand in one row, united: neighbours overlap, and some stand on one another."""
    w = ward_polygons(spark, d).select((F.col("ward") % 4).alias("ward_row"), F.col("ward").alias("polygon"), "xs", "ys")
    u = united(w, "ward_row", size=0.01, grain=1e-12)
    return u.select("ward_row", F.round("area", 9).alias("area"), F.round("length", 7).alias("length"), "corners", "parts", "holes")
