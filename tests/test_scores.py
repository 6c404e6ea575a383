"""Scores against values worked out by hand and against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitlens.functions.columns import ladder
from visitlens.functions.scores import ALL_NO, UNWELL_YES, authenticity, completion_anomaly, shape_score, shape_tests, unwell_completion_anomaly
from visitlens.plans.assess import assessed, batched
from visitlens.plans.fraud import age_shares, monthly_perfection, normal_cdf, normal_distance, sva_scores
from visitlens.plans.ordered import batches


def values(spark, xs, column):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_ladders_by_hand(spark):
    assert np.allclose(values(spark, [0.0, 10.0, 20.0, 30.0, 40.0, 50.0, 60.0, 70.0, 80.0, 90.0, 100.0], completion_anomaly), [0, 0.05, 0.1, 0.3, 0.5, 0.75, 1, 0.75, 0.5, 0.25, 0])
    assert np.allclose(values(spark, [0.0, 25.0, 50.0, 67.5, 85.0, 99.0], unwell_completion_anomaly), [0, 1, 2, 0.5, 0, 0])
    assert np.allclose(values(spark, [5.0, 10.0, 11.0, 13.0, 18.0, 30.0, 60.0], lambda x: ladder(x, *UNWELL_YES)), [0.05, 0.1, 0.15, 0.3, 0.68, 0.9, 1])
    assert np.allclose(values(spark, [5.0, 15.0, 25.0, 35.0, 45.0, 70.0], lambda x: ladder(x, *ALL_NO)), [0.05, 0.2, 0.45, 0.7, 0.9, 1])


def test_sva_by_hand(spark):
    rows = [(1, "a")] * 3 + [(1, "b")] + [(2, "b")] * 4 + [(2, ""), (3, None)]
    got = {(r.flw_id, r.field): r.sva for r in sva_scores(spark.createDataFrame(rows, "flw_id int, x string").withColumn("y", F.col("x")), {"x": 1.0, "y": 2.0}).collect()}
    # All: a 3/8, b 5/8. Worker 1: |3/4 - 3/8| + |1/4 - 5/8| = 0.75; worker 2: 3/8 + 3/8 = 0.75.
    assert got == {(1, "x"): 0.75, (2, "x"): 0.75, (1, "y"): 0.375, (2, "y"): 0.375}


def test_monthly_perfection_by_hand(spark):
    even = [(1, m) for m in range(1, 60)] + [(1, 0)]  # 0 and 1 share the first bin, the last one is empty
    few, one = [(2, 5)] * 19, [(3, 7)] * 20
    v = spark.createDataFrame(even + few + one, "flw_id int, age_months int")
    got = {r.flw_id: r.s for r in age_shares(v, 1).select("flw_id", monthly_perfection().alias("s")).collect()}
    apart = (2 / 60) / (2 - 2 / 60)
    assert np.isclose(got[1], (0.15 - apart) / 0.15) and got[2] is None and got[3] == 0.0


def test_batches_stop_at_the_first_small_one(spark):
    days = lambda flw, *n: [(flw, f"2024-01-{20 - i:02d}") for i, k in enumerate(n) for _ in range(k)]
    rows = days(1, 5, 18) + days(2, 12, 9, 3, 15) + days(3, 25, 4, 6, 11) + days(4, 9)
    v = spark.createDataFrame(rows, "flw_id long, visit_day string").withColumn("visit_day", F.to_date("visit_day"))
    got = sorted((r.flw_id, r.batch, r["size"]) for r in batches(v, 20, 10).collect())
    # 1: the newest day is alone and too small. 2: 12; then 9 + 3; then 15. 3: 25 alone; then 4 + 6; then 11.
    assert got == [(2, 1, 15), (2, 2, 12), (2, 3, 12), (3, 1, 11), (3, 2, 10), (3, 3, 25)]
    sizes = {(r.flw_id, r.batch): r["count"] for r in batched(v, 20, 10).groupBy("flw_id", "batch").count().collect()}
    assert sizes[1, "all"] == 23 and (4, "all") not in sizes and sizes[2, "all"] == 39


def test_assessments_by_hand(spark):
    day = "2024-01-01"
    rows = [(1, day, "female_child", "Green", 30)] * 12 + [(2, day, "male_child", "Red", 5)] * 6 + [(2, day, "female_child", "", 130)] * 6 + [(3, day, "male_child", "Green", 3)] * 200
    v = spark.createDataFrame(rows, "flw_id long, visit_day string, gender string, muac_colour string, age_months int").withColumns({"visit_day": F.to_date("visit_day"), "opportunity_name": F.lit("o")})
    got = {(r.flw_id, r.assessment): (r.value, r.n, r.result) for r in assessed(v).where("batch = 'all'").collect()}
    assert got[1, "low_red_muac"] == (0.0, 12, "strong_negative") and got[2, "low_red_muac"] == (None, 6, "insufficient_data")
    assert got[1, "low_young_child"] == (0.0, 12, "strong_negative") and got[3, "low_young_child"] == (1.0, 200, ".")
    assert got[1, "gender_ratio"] == (1.0, 12, "strong_negative") and got[2, "gender_ratio"] == (0.5, 12, "strong_negative") and got[3, "gender_ratio"] == (0.0, 200, "strong_negative")


def plain_shape(b):
    """The six tests, one bin after the other."""
    n, top = sum(b), max(b)
    peak = b.index(top)
    used = [i for i in range(12) if b[i]]
    step = lambda part: [b[j] - b[i] for i, j in zip(part, part[1:])]
    up, down = step([i for i in used if i <= peak]), step([i for i in used if i >= peak])
    large = [i for i in range(12) if b[i] >= 0.02 * n]
    flat = any(min(b[i : i + 3]) >= max(0.02 * n, 0.2 * top) and max(b[i : i + 3]) - min(b[i : i + 3]) <= 0.03 * top for i in range(10))
    return [
        len(used) >= 5, any(s > 0 for s in up) and all(s >= -0.02 * n for s in up) and any(x >= 0.25 * top for x in b[:peak]),
        len(down) < 2 or (sum(s < 0 for s in down) >= 2 and all(s <= 0.02 * n for s in down)), len(large) < 2 or all(b[large[0] : large[-1] + 1]), not flat, top <= 0.6 * n,
    ]


def test_shape_tests_against_plain_python(spark):
    rng = np.random.default_rng(1)
    some = [[int(x) for x in rng.integers(0, 40, 12) * (rng.random(12) < p)] for p in (0.3, 0.6, 1.0) for _ in range(60)]
    some += [[0, 2, 10, 30, 50, 40, 20, 5, 1, 0, 0, 0], [100] + [0] * 11, [0] * 11 + [30], [10] * 12, [5, 10, 20, 20, 20, 8, 4, 2, 1, 0, 0, 0]]
    some = [b for b in some if sum(b)]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(some)], "i int, bins array<long>")
    got = df.select("i", F.array(*shape_tests(F.col("bins")).values()).alias("t"), shape_score(F.col("bins")).alias("s")).collect()
    points = (1.0, 0.9, 0.8, 0.75, 0.67, 0.5, 0.0)
    for r in got:
        assert r.t == plain_shape(some[r.i]) and r.s == points[sum(r.t)], some[r.i]


def test_authenticity_of_a_natural_shape(spark):
    df = spark.createDataFrame([([0, 2, 20, 60, 100, 64, 30, 8, 2, 0, 0, 0],), ([0, 0, 0, 100, 0, 0, 0, 0, 0, 0, 0, 0],)], "bins array<long>")
    a, b = (r.asDict() for r in df.select(*(c.alias(k) for k, c in authenticity(F.col("bins")).items())).collect())
    slope = np.polyfit([1, 2, 3, 4], [2, 20, 60, 100], 1)[0] / 100, -np.polyfit([4, 5, 6, 7, 8], [100, 64, 30, 8, 2], 1)[0] / 100
    assert a["up_points"] == (2.0 if slope[0] <= 0.3 else 1.0) and a["down_points"] == (2.0 if slope[1] <= 0.3 else 1.0)
    assert a["bins_points"] == 2 and a["peak_points"] == 2 and a["rising_points"] == a["falling_points"] == 1 and a["plateau_points"] == 1
    assert sum(b.values()) == 1.0  # one bin alone: only no plateau


def test_normal_distances_against_plain_python(spark):
    z = np.array([-8.0, -3.5, -3.0, -1.0, 0.0, 0.3, 2.9, 3.1, 6.0])
    assert np.allclose(normal_cdf(z), [0.5 * math.erfc(-x / math.sqrt(2)) for x in z], rtol=1e-10, atol=1e-300)
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(15, 2, 400), 1)
    got = normal_distance(spark.createDataFrame([(1, float(v)) for v in x], "k int, x double").repartition(3), "k", "x").first()
    s = np.sort(x)
    p = np.array([0.5 * math.erfc(-(v - x.mean()) / x.std(ddof=1) / math.sqrt(2)) for v in s])
    i = np.arange(1, len(s) + 1)
    assert np.isclose(got.ks, max((i / len(s) - p).max(), (p - (i - 1) / len(s)).max()))
    assert np.isclose(got.anderson, -len(s) - ((2 * i - 1) * (np.log(p) + np.log(1 - p[::-1]))).mean())


@pytest.mark.parametrize("missing", [0, 1])
def test_composite_is_the_mean_of_what_is_there(spark, missing):
    from visitlens.plans.fraud import weighted_composite

    df = spark.createDataFrame([(1.0, None if missing else 0.0)], "a double, b double")
    assert df.select(weighted_composite([(F.col("a"), 3.0), (F.col("b"), 1.0)])).first()[0] == (1.0 if missing else 0.75)
