"""Clusters of visits in metres, their tables and outlines, and places in projected metres."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.functions.columns import haversine_km
from visitlens.functions.geodesy import from_utm, to_utm, utm_sql
from visitlens.operators.graph import min_label_components
from visitlens.operators.outline import concave_edges
from visitlens.operators.ranks import counted_percentiles
from visitlens.operators.rings import rings
from visitlens.plans.grid import hull
from visitlens.plans.places import area_of, outline
from visitlens.registry import query
from visitlens.sources.storage import saved
from visitlens.sources.views import visits, with_views

ZONE = 32
_EAST, _NORTH = utm_sql("latitude", "longitude", ZONE)


@query("scal_transverse_mercator", with_views(f"SELECT visit_id, ROUND({_EAST}, 3) AS east, ROUND({_NORTH}, 3) AS north FROM visits"))
def transverse_mercator(spark: SparkSession, d: str) -> DataFrame:
    """Places in metres of UTM zone 32."""
    east, north = to_utm(F.col("latitude"), F.col("longitude"), ZONE)
    return visits(spark, d).select("visit_id", F.round(east, 3).alias("east"), F.round(north, 3).alias("north"))


@query("scal_utm_round_trip", with_views("SELECT visit_id, ROUND(latitude, 9) AS latitude, ROUND(longitude, 9) AS longitude FROM visits"))
def utm_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """To metres and back to degrees: the same places, to a tenth of a millimetre."""
    east, north = to_utm(F.col("latitude"), F.col("longitude"), ZONE)
    there = visits(spark, d).select("visit_id", east.alias("east"), north.alias("north"))
    lat, lon = from_utm(F.col("east"), F.col("north"), ZONE)
    return there.select("visit_id", F.round(lat, 9).alias("latitude"), F.round(lon, 9).alias("longitude"))


def linked_clusters(v: DataFrame, key: str, metres: float, least: int) -> DataFrame:
    """v (key, id, latitude, longitude, ...) with `cluster`: single-link clusters of places within `metres` on the sphere, named by
    their least id; null for those of fewer than `least` rows.

    Equal places are one. Buckets are no smaller than the reach at any latitude of the table, so neighbours are in the nine
    around, and the distance decides.
    """
    places = saved(v.groupBy(key, "latitude", "longitude").agg(F.min("id").alias("place"), F.count("*").alias("n")), "places")
    top = F.broadcast(places.agg(F.max(F.abs("latitude")).alias("top")))
    high = metres / 111_000.0
    wide = F.lit(high) / F.cos(F.radians(F.least(F.col("top") + high, F.lit(89.9))))
    p = places.join(top).select(key, "place", "latitude", "longitude", F.floor(F.col("latitude") / high).alias("a"), F.floor(F.col("longitude") / wide).alias("b"))
    around = F.sequence(F.lit(-1), F.lit(1))
    spread = p.select(key, "place", "latitude", "longitude", F.explode(F.transform(around, lambda i: F.col("a") + i)).alias("a"), "b").withColumn("b", F.explode(F.transform(around, lambda i: F.col("b") + i)))
    other = p.select(key, F.col("place").alias("v"), F.col("latitude").alias("lat2"), F.col("longitude").alias("lon2"), "a", "b")
    near = 1000 * haversine_km(F.col("latitude"), F.col("longitude"), F.col("lat2"), F.col("lon2")) <= metres
    edges = spread.join(other, [key, "a", "b"]).where((F.col("place") < F.col("v")) & near).select(F.col("place").alias("u"), "v")
    labels = min_label_components(places.select(F.col("place").alias("id")), edges).withColumnRenamed("id", "place")
    named = saved(places.join(labels, "place"), "named")
    sizes = named.groupBy("component").agg(F.sum("n").alias("size"))
    cluster = F.when(F.col("size") >= least, F.col("component")).alias("cluster")
    return v.join(named.join(sizes, "component").select(key, "latitude", "longitude", cluster), [key, "latitude", "longitude"])


def _unit(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], -1)


def corners_of(lat: np.ndarray, lon: np.ndarray, middle: tuple[float, float]) -> np.ndarray:
    """Rows of the places that are corners of the spherical hull: great circles are lines in a plane that touches at the middle."""
    p, m = _unit(lat, lon), _unit(*map(np.array, middle))
    east = np.cross([0.0, 0.0, 1.0], m)
    east /= np.linalg.norm(east)
    flat = np.stack([p @ east, p @ np.cross(m, east)], 1) / (p @ m)[:, None]
    found = {tuple(c) for c in hull(flat)}
    return np.array([i for i, c in enumerate(map(tuple, flat)) if c in found], np.int64)


def diameter_m(lat: np.ndarray, lon: np.ndarray, radius: float = 6371.0) -> float:
    """Metres between the two places farthest apart on the sphere."""
    p, far = _unit(lat, lon), 0.0
    for a in range(0, len(p), 512):
        chords = p[a : a + 512, None] - p[None]
        far = max(far, float((chords**2).sum(-1).max(initial=0.0)))
    return 2000 * radius * float(np.arcsin(min(1.0, np.sqrt(far) / 2)))


def cluster_shapes(v: DataFrame, key: list[str], buffer: float, sides: int = 32) -> DataFrame:
    """(key, diameter_m, corners, outline_km2, wkt) of the groups of places (latitude, longitude).

    Tasks send only corners of hulls, and a group's task merges these: the farthest two places are corners of the spherical
    hull. The outline is the convex hull in metres of the projection, widened by `buffer` metres with rounded corners; groups
    of fewer than three rows have none.
    """
    kinds = ", ".join(f"{k} {v.schema[k].dataType.simpleString()}" for k in key)
    middle = v.groupBy(*key).agg(F.avg("latitude").alias("mlat"), F.avg("longitude").alias("mlon"), F.count("*").alias("rows"))
    east, north = to_utm(F.col("latitude"), F.col("longitude"), ZONE)
    places = v.select(*key, "latitude", "longitude").distinct().join(middle, key).select("*", east.alias("east"), north.alias("north"))
    columns = "mlat double, mlon double, rows bigint, latitude double, longitude double, east double, north double"

    def keep(g: pd.DataFrame) -> pd.DataFrame:
        near = corners_of(g["latitude"].to_numpy(), g["longitude"].to_numpy(), (g["mlat"].iloc[0], g["mlon"].iloc[0]))
        flat = {tuple(c) for c in hull(g[["east", "north"]].to_numpy())}
        own = np.array([(a, b) in flat for a, b in zip(g["east"], g["north"], strict=True)], bool)
        own[near] = True
        return g[own]

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, g in b.groupby(key):
                yield keep(g)[[*key, *(c.split()[0] for c in columns.split(", "))]]

    def shape(g: pd.DataFrame) -> pd.DataFrame:
        ring = outline(hull(g[["east", "north"]].to_numpy()), buffer, sides)
        has = g["rows"].iloc[0] >= 3 and len(ring) > 2
        far = diameter_m(g["latitude"].to_numpy(), g["longitude"].to_numpy())
        own = {k: [g[k].iloc[0]] for k in key}
        return pd.DataFrame({**own, "diameter_m": [far], "corners": [len(ring) if has else 0], "outline_km2": [area_of(ring) / 1e6 if has else 0.0], "xs": [ring[:, 0].tolist() if has else []], "ys": [ring[:, 1].tolist() if has else []]})

    few = places.mapInPandas(thin, f"{kinds}, {columns}")
    shapes = few.groupBy(*key).applyInPandas(shape, f"{kinds}, diameter_m double, corners bigint, outline_km2 double, xs array<double>, ys array<double>")
    return shapes.select(*key, "diameter_m", "corners", "outline_km2", utm_text(F.col("xs"), F.col("ys")).alias("wkt"))


def utm_text(xs: Column, ys: Column) -> Column:
    """A ring in projected metres as a polygon in degrees, in text form; null without corners."""

    def point(p: Column) -> Column:
        lat, lon = from_utm(p["x"], p["y"], ZONE)
        return F.concat_ws(" ", F.round(lon, 7).cast("string"), F.round(lat, 7).cast("string"))

    texts = F.transform(F.arrays_zip(xs.alias("x"), ys.alias("y")), point)
    return F.when(F.size(xs) > 0, F.concat(F.lit("POLYGON (("), F.array_join(F.concat(texts, F.slice(texts, 1, 1)), ", "), F.lit("))")))


@query("aggr_cluster_table")
def cluster_table(spark: SparkSession, d: str, metres: float = 250.0, least: int = 3, buffer: float = 100.0) -> DataFrame:
    """One row for each cluster of an opportunity's visits, and one for its outliers (null): centroid, box and its sides in metres,
    the distance of the two farthest visits, and the outline with a buffer."""
    key = ["opportunity_id", "cluster"]
    v = visits(spark, d).select("opportunity_id", F.col("visit_id").alias("id"), "latitude", "longitude")
    c = saved(linked_clusters(v, "opportunity_id", metres, least), "clusters")
    lat, lon = F.avg("latitude"), F.avg("longitude")
    side = lambda *at: F.round(1000 * haversine_km(*at), 2)
    r = c.groupBy(*key).agg(
        F.count("*").alias("visits"), F.round(lat, 6).alias("center_latitude"), F.round(lon, 6).alias("center_longitude"), *(F.round(f(x), 6).alias(f"bbox_{n}_{x[:3]}") for x in ("latitude", "longitude") for n, f in (("min", F.min), ("max", F.max))),
        side(lat, F.min("longitude"), lat, F.max("longitude")).alias("bbox_width_m"), side(F.min("latitude"), lon, F.max("latitude"), lon).alias("bbox_height_m"),
    )
    shapes = cluster_shapes(c.where("cluster IS NOT NULL"), key, buffer)
    return r.join(shapes.select(*key, F.round("diameter_m", 2).alias("max_internal_distance_m"), "corners", F.round("outline_km2", 6).alias("outline_km2"), "wkt"), key, "left")


@query("udf_projected_wards")
def projected_wards(spark: SparkSession, d: str, most_km: float = 75.0, least: int = 500, buffer: float = 500.0) -> DataFrame:
    """The hull of an opportunity's visits within most_km of their median place, widened by a buffer in projected metres; only from
    `least` such visits on. Medians come from counts, so no task holds a group's values."""
    v = visits(spark, d).select("opportunity_id", "latitude", "longitude")
    middle = [counted_percentiles(v, "opportunity_id", c, [0.5], "q").select("opportunity_id", F.col("q")[0].alias(f"m_{c}")) for c in ("latitude", "longitude")]
    near = v.join(middle[0].join(middle[1], "opportunity_id"), "opportunity_id")
    near = near.where(haversine_km(F.col("latitude"), F.col("longitude"), F.col("m_latitude"), F.col("m_longitude")) <= most_km)
    used = near.groupBy("opportunity_id").agg(F.count("*").alias("used")).where(F.col("used") >= least)
    shapes = cluster_shapes(near.join(used, "opportunity_id", "left_semi").select("opportunity_id", "latitude", "longitude"), ["opportunity_id"], buffer)
    return used.join(shapes, "opportunity_id").select("opportunity_id", "used", "corners", F.round("outline_km2", 6).alias("area_km2"), F.round("diameter_m", 2).alias("diameter_m"), "wkt")


@query("udf_concave_outlines")
def concave_outlines(spark: SparkSession, d: str, radius: float = 400.0) -> DataFrame:
    """Concave outlines of each opportunity's visits in projected metres: parts, holes and corners of all that is within, and the
    outer ring of the largest part."""
    east, north = to_utm(F.col("latitude"), F.col("longitude"), ZONE)
    places = visits(spark, d).select("opportunity_id", F.round(east, 3).alias("x"), F.round(north, 3).alias("y"))
    r = saved(rings(concave_edges(places, "opportunity_id", radius), "opportunity_id"), "outlines")
    outer = F.col("area") > 0
    largest = F.max_by(F.struct("area", "xs", "ys"), F.struct("area", "ring"))
    sums = r.groupBy("opportunity_id").agg(
        F.count_if(outer).alias("parts"), F.count_if(~outer).alias("holes"), F.sum("corners").alias("corners"), F.round(F.sum("area") / 1e6, 6).alias("area_km2"), largest.alias("l")
    )
    return sums.select("opportunity_id", "parts", "holes", "corners", "area_km2", F.round(F.col("l.area") / 1e6, 6).alias("largest_km2"), utm_text(F.col("l.xs"), F.col("l.ys")).alias("wkt"))
