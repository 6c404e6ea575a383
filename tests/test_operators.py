"""Operators and helpers by themselves, against plain Python."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from visitlens.functions.columns import ladder, right_closed_bin, wilson
from visitlens.functions.resolve import containing, exactly, standardised
from visitlens.operators.graph import min_label_components
from visitlens.plans.cleaning import token_sort_ratio
from visitlens.plans.grid import hull, nearest_in_rings
from visitlens.plans.ordered import batches


def test_resolvers(spark):
    assert containing(["Visit_ID", "visit_date"], ["date", "id"]) == "visit_date"
    assert containing(["a"], ["b"]) is None
    assert exactly([" FLW ID ", "x"], ["flw_id", "flw id"]) == " FLW ID "
    df = spark.createDataFrame([(1, 2)], "`Worker` int, y int")
    assert standardised(df, {"flw_id": ["worker"], "z": ["none"]}).columns == ["flw_id", "y"]


def test_ladder_and_bins(spark):
    df = spark.createDataFrame([(x,) for x in (None, -1.0, 0.0, 0.5, 1.0, 1.5, 2.0, 9.0)], "x double")
    got = [r[0] for r in df.select(ladder(F.col("x"), (0.0, 1.0), (1.0, 0.0), (2.0, 4.0))).collect()]
    assert got == [None, 1.0, 1.0, 0.5, 0.0, 2.0, 4.0, 4.0]
    bins = [r[0] for r in df.where("x >= 0").select(right_closed_bin("x", 0, 1.0)).collect()]
    assert bins == [0, 0, 0, 1, 1, 8]


def test_wilson_holds_the_share(spark):
    df = spark.createDataFrame([(3, 10), (0, 5), (5, 5)], "s int, n int")
    low, high = wilson(F.col("s"), F.col("n"))
    assert all(a <= s / n <= b for s, n, a, b in df.select("s", "n", low, high).collect())


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(60) if rng.random() < 0.8] + [(rng.randrange(60), rng.randrange(60)) for _ in range(3)]
    root = list(range(61))
    for _ in root:
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    nodes = spark.range(61).select("id")
    got = min_label_components(nodes, spark.createDataFrame(edges, "u long, v long"))
    assert {r.id: r.component for r in got.collect()} == dict(enumerate(root))


def test_batches_of_whole_days(spark):
    days = [("2024-01-01", 8), ("2024-01-02", 12), ("2024-01-03", 5), ("2024-01-05", 25), ("2024-01-06", 3)]
    rows = [(1, d) for d, n in days for _ in range(n)] + [(2, "2024-01-01")] * 3
    v = spark.createDataFrame(rows, "flw_id long, visit_day string").withColumn("visit_day", F.to_date("visit_day"))
    got = [(r.flw_id, r.batch, r.size, str(r.first_day), str(r.last_day)) for r in batches(v, 20, 3).orderBy("flw_id", "batch").collect()]
    assert got == [(1, 1, 8, "2024-01-01", "2024-01-01"), (1, 2, 17, "2024-01-02", "2024-01-03"), (1, 3, 25, "2024-01-05", "2024-01-05"), (1, 4, 3, "2024-01-06", "2024-01-06"), (2, 1, 3, "2024-01-01", "2024-01-01")]


def test_hull():
    points = np.array([(0, 0), (4, 0), (4, 4), (0, 4), (2, 2), (4, 2), (0, 0)])
    assert hull(points).tolist() == [[0, 0], [4, 0], [4, 4], [0, 4]]
    assert len(hull(points[:1])) == 1


def test_nearest_in_rings(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 60, (40, 2)), rng.integers(0, 60, (15, 2))
    got = nearest_in_rings(spark.createDataFrame(pd.DataFrame(a, columns=["row", "col"])).distinct(), spark.createDataFrame(pd.DataFrame(b, columns=["r", "c"])), width=8)
    for r in got.collect():
        assert np.isclose(r.distance, np.sqrt(((b - [r.row, r.col]) ** 2).sum(1).min()), atol=1e-4)
    assert got.count() == len({tuple(x) for x in a.tolist()})


def test_token_sort_ratio():
    assert token_sort_ratio("Foo bar", "bar FOO") == 100 and token_sort_ratio("", "a") == 0
    assert token_sort_ratio("abcd", "abxd") == 75


def test_inside_by_the_even_odd_rule(spark):
    from visitlens.plans.further import inside

    xs, ys = F.array(*map(F.lit, (0.0, 4.0, 4.0, 2.0, 0.0))), F.array(*map(F.lit, (0.0, 0.0, 4.0, 2.0, 4.0)))
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.5, 3.0), (5.0, 1.0), (-1.0, 2.0)], "x double, y double")
    assert [r[0] for r in df.select(inside(F.col("x"), F.col("y"), xs, ys)).collect()] == [True, False, True, False, False]


def test_geodesic_on_known_distances():
    from visitlens.plans.further import geodesic_km

    got = geodesic_km(*(np.array(x) for x in ([0.0, 0.0, 50.0], [0.0, 0.0, 5.0], [0.0, 1.0, 50.0], [1.0, 0.0, 5.0])))
    assert np.allclose(got, [111.3194908, 110.5743886, 0.0], atol=1e-4)
