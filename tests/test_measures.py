"""Projections, geodesics, clusters, normality, counted percentiles and look-back counts, against published values and plain Python."""

import datetime as dt
from math import asin, cos, exp, log, pi, radians, sin, sqrt
from statistics import NormalDist

import numpy as np
import pytest

from pyspark.sql import functions as F

from visitlens.functions.geodesy import A, from_utm, geodesic_m, to_utm
from visitlens.operators.lookback import distinct_in_range
from visitlens.operators.ranks import counted_percentiles, running_counts
from visitlens.plans.clusters import cluster_shapes, diameter_m, linked_clusters
from visitlens.plans.statistics import normal_quantile, shapiro_wilk


def test_utm_at_a_published_point_and_back(spark):
    rows = [(43 + 38 / 60 + 33.24 / 3600, -(79 + 23 / 60 + 13.7 / 3600))] + [(lat, -81.0 + off) for lat in (-79.0, -1e-9, 0.0, 9.1, 60.0, 83.9) for off in (-3.0, -0.1, 0.0, 2.9)]
    east, north = to_utm(F.col("lat"), F.col("lon"), 17)
    there = spark.createDataFrame(rows, "lat double, lon double").select("lat", "lon", east.alias("e"), north.alias("n"))
    lat, lon = from_utm(F.col("e"), F.col("n"), 17)
    got = there.select("*", lat.alias("lat2"), lon.alias("lon2")).collect()
    assert (round(got[0].e), round(got[0].n)) == (630084, 4833439)
    assert all(abs(r.lat - r.lat2) < 1e-9 and abs(r.lon - r.lon2) * cos(radians(r.lat)) < 1e-9 for r in got)  # a tenth of a millimetre
    on_meridian = [r for r in got if r.lon == -81.0]
    assert all(abs(r.e - 500_000) < 1e-6 and abs(abs(r.n) - 0.9996 * geodesic_m(0, 0, abs(r.lat), 0)[0]) < 1e-3 for r in on_meridian)


def test_geodesics_at_published_points():
    cases = [((0, 0, 0.5, 179.5), 19936288.579), ((0, 0, 0.5, 179.7), 19944127.421), ((90, 0, -90, 10), 20003931.4586), ((0, 0, 0, 180), 20003931.4586), ((40.6, -73.8, 51.6, -0.5), 5551759.4003), ((-30, 0, 29.9, 179.8), 19989832.8276), ((0, 0, 0, 90), A * pi / 2), ((5, 5, 5, 5), 0.0)]
    got = geodesic_m(*np.array([c for c, _ in cases], float).T)
    assert np.allclose(got, [m for _, m in cases], atol=1e-3)
    turned = geodesic_m(*np.array([(c[2], c[3], c[0], c[1]) for c, _ in cases], float).T)
    assert np.allclose(got, turned, atol=1e-6) and np.isnan(geodesic_m(np.nan, 0, 0, 0)).all()
    near = np.random.default_rng(1).uniform(-0.6, 0.6, (2, 500))
    assert np.isfinite(geodesic_m(np.zeros(500), np.zeros(500), near[0], 180 + near[1])).all()


def km(a, b):
    x = sin(radians(b[0] - a[0]) / 2) ** 2 + cos(radians(a[0])) * cos(radians(b[0])) * sin(radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * asin(sqrt(x))


def test_clusters_in_metres(spark):
    g = np.random.default_rng(3)
    rows = [(i % 2, i, 60 + round(float(a), 4), 7 + round(float(b), 4)) for i, (a, b) in enumerate(g.random((240, 2)) * [0.02, 0.04])] + [(0, 900 + i, 60.5, 8.0) for i in range(3)] + [(1, 990, 60.5, 8.0)]
    df = spark.createDataFrame(rows, "k long, id long, latitude double, longitude double").repartition(3)
    got = {r.id: r.cluster for r in linked_clusters(df, "k", 200.0, 3).collect()}
    label = {r[1]: r[1] for r in rows}
    moved = True
    while moved:
        moved = False
        for a in rows:
            for b in rows:
                if a[0] == b[0] and label[b[1]] < label[a[1]] and 1000 * km(a[2:], b[2:]) <= 200:
                    label[a[1]], moved = label[b[1]], True
    sizes = {c: sum(x == c for x in label.values()) for c in label.values()}
    assert got == {i: c if sizes[c] >= 3 else None for i, c in label.items()} and 3 < len(set(got.values())) < 100

    shapes = cluster_shapes(df, ["k"], 50.0).collect()
    for r in shapes:
        own = [x[2:] for x in rows if x[0] == r.k]
        assert np.isclose(r.diameter_m, max(1000 * km(a, b) for a in own for b in own), atol=1e-4)
        ring = np.array([[float(v) for v in p.split()] for p in r.wkt[10:-2].split(", ")])
        x, y, x2, y2 = ring[:-1, 0], ring[:-1, 1], ring[1:, 0], ring[1:, 1]
        assert len(ring) == r.corners + 1 and all(((x2 - x) * (lat - y) - (y2 - y) * (lon - x) > 0).all() for lat, lon in own)


def test_diameter_over_the_date_line_and_the_pole():
    lat, lon = np.array([89.0, 89.0, 88.0]), np.array([0.0, 180.0, 90.0])
    assert np.isclose(diameter_m(lat, lon), max(1000 * km(a, b) for a in zip(lat, lon) for b in zip(lat, lon)))


def plain_shapiro(x):
    """The approximation step by step, with the library's normal distribution."""
    x, n, N = sorted(x), len(x), NormalDist()
    m = [N.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    mm, u = sum(v * v for v in m), 1 / sqrt(n)
    a = [0.0] * n
    if n == 3:
        a = [-sqrt(0.5), 0.0, sqrt(0.5)]
    else:
        a[-1] = np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, m[-1] / sqrt(mm)], u)
        if n > 5:
            a[-2] = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / sqrt(mm)], u)
            root, k = sqrt((mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * a[-1] ** 2 - 2 * a[-2] ** 2)), 2
        else:
            root, k = sqrt((mm - 2 * m[-1] ** 2) / (1 - 2 * a[-1] ** 2)), 1
        a[k : n - k] = [v / root for v in m[k : n - k]]
        a[:k] = [-v for v in a[: -k - 1 : -1]]
    mean = sum(x) / n
    w = min(1.0, sum(p * q for p, q in zip(a, x)) ** 2 / sum((v - mean) ** 2 for v in x))
    if n == 3:
        return w, max(0.0, 6 / pi * (asin(sqrt(w)) - asin(sqrt(0.75))))
    if n <= 11:
        z = (-log(-2.273 + 0.459 * n - log(1 - w)) - np.polyval([-0.0006714, 0.025054, -0.39978, 0.544], n)) / exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        z = (log(1 - w) - np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], log(n))) / exp(np.polyval([0.0030302, -0.082676, -0.4803], log(n)))
    return w, 1 - N.cdf(z)


def test_shapiro_wilk(spark):
    weights = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]  # published with W = 0.79
    g = np.random.default_rng(4)
    groups = {0: weights, 3: [1, 2, 4], 4: [1, 2, 4, 9], 5: [5, 1, 2, 4, 4], 6: [1, 2, 3, 4, 5, 7], 40: np.round(g.normal(15, 2, 40), 1), 500: np.round(g.normal(15, 2, 500), 1), 5000: np.round(g.normal(15, 2, 5000), 1), 700: g.exponential(1, 700)}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [(99, 1.0), (99, 1.0), (99, 1.0), (98, 2.0)] + [(0, None)] + [(5001, float(i)) for i in range(5001)]
    got = {r.k: r for r in shapiro_wilk(spark.createDataFrame(rows, "k long, x double").repartition(3), "k", "x").collect()}
    assert set(got) == set(groups) and round(got[0].w, 2) == 0.79 and got[0].n == 11
    for k, x in groups.items():
        assert np.allclose((got[k].w, got[k].p), plain_shapiro([float(v) for v in x]), atol=1e-6)
    assert got[700].p < 1e-6 < 0.05 < got[500].p
    p = [1e-300, 1e-12, 1e-3, 0.07, 0.08, 0.5, 0.9, 0.999999]
    found = [r[0] for r in spark.createDataFrame([(v,) for v in p], "p double").select(normal_quantile(F.col("p"))).collect()]
    assert np.allclose(found, [NormalDist().inv_cdf(v) for v in p], rtol=1e-12, atol=1e-14)


@pytest.mark.parametrize("hot", [False, True])
def test_counted_percentiles(spark, hot):
    g = np.random.default_rng(5)
    rows = [(0 if hot and i % 3 else int(g.integers(0, 4)), None if i % 50 == 0 else float(np.round(g.normal(), 1 if i % 2 else 5))) for i in range(4000)] + [(None, 1.0), (None, 3.0), (7, None)]
    df = spark.createDataFrame(rows, "k long, x double").repartition(5)
    points = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r.k: r.q for r in counted_percentiles(df, "k", "x", points, "q").collect()}
    keys = {k for k, v in rows if v is not None}
    assert set(got) == keys
    for k in keys:
        assert np.allclose(got[k], np.quantile([v for q, v in rows if q == k and v is not None], points))
    counts = {(r.k, r.x): (r["count"], r.upto) for r in running_counts(df, "k", "x").collect()}
    own = sorted(v for k, v in rows if k == 0 and v is not None)
    assert all(counts[0, v] == (own.count(v), sum(w <= v for w in own)) for v in set(own[::37]))


def test_distinct_members_in_a_range(spark):
    g = np.random.default_rng(6)
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(int(n))
    sights = [(int(g.integers(0, 2)), int(g.integers(0, 9)), day(g.integers(0, 60))) for _ in range(150)] + [(0, 1, day(5))] * 3
    at = [(k, day(n)) for k in (0, 1, 2) for n in range(-3, 75, 2)]
    s, a = spark.createDataFrame(sights, "k long, m long, day date"), spark.createDataFrame(at, "k long, day date")
    got = {(r.k, r.day): r.w for r in distinct_in_range(s, a, ["k"], "m", "day", 10, "w").collect()}
    assert got == {(k, d): len({m for q, m, e in sights if q == k and 0 <= (d - e).days < 10}) for k, d in at}


def test_folds_find_the_workers_that_make_answers_up(spark):
    from visitlens import registry

    got = {r.fold: r.auc for r in registry.queries()["ml_fold_scores"](spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == 13 and got["mean"] > 0.95


def test_silhouettes_are_those_of_plain_python(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    from visitlens import registry
    from visitlens.plans.learning import without_lonely
    from visitlens.sources.views import visits

    sf_dir = "/root/testdata/sf0.001"
    got = {r.k: (r.silhouette, r.is_best) for r in registry.queries()["ml_k_means"](spark, sf_dir).collect()}
    v = without_lonely(visits(spark, sf_dir).select(F.lit(0).alias("all"), "visit_id", "latitude", "longitude"), "all", 500.0)
    points = VectorAssembler(inputCols=["latitude", "longitude"], outputCol="features").transform(v.select("visit_id", "latitude", "longitude"))
    k = max(got, key=lambda x: got[x][0])
    assert [x for x in got if got[x][1]] == [k]
    rows = KMeans(k=k, seed=42).fit(points).transform(points).select("latitude", "longitude", "prediction").collect()
    p, c = np.array([(r.latitude, r.longitude) for r in rows]), np.array([r.prediction for r in rows])
    d = ((p[:, None] - p[None]) ** 2).sum(2)  # squared distances, as the evaluator has them
    s = []
    for i in range(len(p)):
        own = (c == c[i]) & (np.arange(len(p)) != i)
        a = d[i, own].mean() if own.any() else None
        b = min(d[i, c == o].mean() for o in set(c) - {c[i]})
        s.append(0.0 if a is None else (b - a) / max(a, b))
    assert abs(np.mean(s) - got[k][0]) < 0.02


def test_clusters_weigh_places_by_their_visits(spark, tmp_path, monkeypatch):
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler

    from visitlens import registry
    from visitlens.plans import learning

    g = np.random.default_rng(12)
    rows = [(k, int(g.integers(0, k)), float(x) / 1000, float(y) / 1000, int(n)) for k in (2, 4) for x, y, n in g.integers(1, 90, (60, 3))] + [(4, 9, 5.0, 5.0, 1)]
    assigned = spark.createDataFrame(rows, "k int, prediction int, x double, y double, n long")
    got = learning.silhouettes(assigned)
    points = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(assigned.selectExpr("*", "explode(sequence(1, n)) AS i"))
    for k in (2, 4):
        assert abs(got[k] - ClusteringEvaluator().evaluate(points.where(F.col("k") == k).withColumn("prediction", F.col("prediction").cast("double")))) < 1e-9

    # Ten thousand visits at 36 places in three groups: the models read 36 rows, and the best number of clusters is three.
    e = spark.range(10_000).selectExpr("id * 100 + (id % 3) * 40 + (id DIV 3) % 6 AS event_id", "timestamp'2024-01-01' AS ts", "id % 7 AS user_id", "'view' AS event_type", "1.0D AS value", "concat('{\"k\": ', (id % 3) * 40 + (id DIV 18) % 2, '}') AS props")
    e.write.parquet(f"{tmp_path}/events.parquet")
    fit, sizes = learning.KMeans.fit, []
    monkeypatch.setattr(learning.KMeans, "fit", lambda self, df, *a: (sizes.append(df.count()), fit(self, df, *a))[1])
    out = {r.k: r for r in registry.queries()["ml_k_means"](spark, str(tmp_path)).collect()}
    assert set(sizes) == {36} and [k for k in out if out[k].is_best] == [3] and out[3].silhouette > 0.9
