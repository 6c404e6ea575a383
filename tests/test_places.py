"""Names, clusters, tours, outlines, streams and folds against plain Python."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from visitlens import registry
from visitlens.plans.cleaning import token_sort_ratio
from visitlens.plans.grid import ball_clusters, grown_clusters
from visitlens.plans.intake import match_names
from visitlens.plans.learning import dealt_folds, without_lonely
from visitlens.plans.places import area_of, outline, proxy_wards


def km(a, b):
    (p, q), (r, s) = np.radians(a), np.radians(b)
    return 2 * 6371.0 * np.arcsin(np.sqrt(np.sin((r - p) / 2) ** 2 + np.cos(p) * np.cos(r) * np.sin((s - q) / 2) ** 2))


def test_names_are_matched_as_by_comparing_all(spark):
    rng = np.random.default_rng(5)
    words = ["gari", "tudun", "wada", "sabon", "birnin", "kebbi", "ung", "sarki", "a", "dan"]
    name = lambda: " ".join(rng.choice(words, int(rng.integers(1, 4))))

    def bent(x):
        out = list(x)
        for _ in range(int(rng.integers(0, 3))):
            out[int(rng.integers(0, len(out)))] = "xyz"[int(rng.integers(0, 3))]
        return "".join(out).upper()

    v = [(i, name(), "s", f"l{i % 2}", f"w{i % 4}") for i in range(120)] + [(900, "tudun wada", "s", "l0", "nowhere"), (901, "tudun wada", "other", "l0", "w0")]
    s = [(1000 + i, bent(v[int(rng.integers(0, 120))][1]), "S", f"L{i % 2}", f"W{i % 4}") for i in range(150)] + [(2000, "Wada  TUDUN", "S", "L0", "W0")]
    frame = lambda rows: spark.createDataFrame(rows, "id long, name string, state string, lga string, ward string")
    got = {r.id: (r.match, r.ratio) for r in match_names(frame(v), frame(s)).collect()}
    want = {}
    for i, n, *at in v:
        near = [x for depth in (3, 2, 1) for x in [[y for y in s if [z.lower() for z in y[2 : 2 + depth]] == at[:depth]]] if x]
        ratios = [(-round(token_sort_ratio(n, y[1]), 4), y[0]) for y in (near[0] if near else [])]
        best = min(ratios, default=(0, None))
        if -best[0] >= 80:
            want[i] = (best[1], -best[0])
    assert got == want and len(want) > 40 and 900 in got and 901 not in got


def test_two_names_are_compared_once(spark, monkeypatch, tmp_path):
    from visitlens.plans import cleaning, intake

    rng = np.random.default_rng(9)
    name = lambda: "".join(rng.choice(list("abcde \u0130\U0001f600"), int(rng.integers(0, 14))))
    a, b = [name() for _ in range(400)] + ["x" * 3000, "b a"], [name() for _ in range(400)] + ["yx" * 1500, "A  B"]
    want = [token_sort_ratio(x, y) for x, y in zip(a, b, strict=True)]
    assert all(cleaning.token_sort_ratios(a, b, most).tolist() == want for most in (1, 50, 1 << 20)) and not len(cleaning.token_sort_ratios([], []))
    real, log = cleaning.token_sort_ratios, str(tmp_path)

    def logged(a, b):
        import uuid

        with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
            f.writelines(f"{x}|{y}\n" for x, y in zip(a, b, strict=True))
        return real(a, b)

    monkeypatch.setattr(intake, "token_sort_ratios", logged)
    frame = lambda k: spark.createDataFrame([(k + i, n, "s", "l", f"w{i // 3}") for i, n in enumerate(["tudun wada", "sabon gari", "birnin kebbi"] * 20)], "id long, name string, state string, lga string, ward string")
    got = {r.id: (r.match, r.ratio) for r in match_names(frame(0), frame(1000)).collect()}
    assert got == {i: (1000 + i, 100.0) for i in range(60)}
    compared = [x for p in tmp_path.iterdir() for x in p.read_text().splitlines()]
    assert len(compared) == len(set(compared)) >= 3


def test_grown_clusters(spark):
    rng = np.random.default_rng(2)
    p = [(i, int(x), int(y)) for i, (x, y) in enumerate(rng.integers(-40, 40, (120, 2)))]
    root = list(range(len(p)))
    for _ in p:
        for i, x, y in p:
            for j, u, w in p:
                if (x - u) ** 2 + (y - w) ** 2 <= 25:
                    root[i] = root[j] = min(root[i], root[j])
    got = {r.id: r.cluster for r in grown_clusters(spark.createDataFrame(p, "id long, x long, y long"), 5, 3).collect()}
    assert got == {i: (root[i] if root.count(root[i]) >= 3 else None) for i in range(len(p))}


def test_balls_are_those_of_one_worker_at_a_time(spark):
    rng = np.random.default_rng(3)
    rows = [(int(f), i, 9 + round(float(a), 3), 7 + round(float(b), 3)) for i, (f, a, b) in enumerate(zip(rng.integers(0, 3, 250), rng.random(250) * 0.08, rng.random(250) * 0.08))]
    got = {(r.flw_id, r.visit_id): r.cluster for r in ball_clusters(spark.createDataFrame(rows, "flw_id long, visit_id long, latitude double, longitude double"), 1.0, 3).collect()}
    want = {}
    for f in range(3):
        own = [r for r in rows if r[0] == f]
        for r in own:
            if (f, r[1]) in want:
                continue
            near = [q for q in own if (f, q[1]) not in want and km(r[2:], q[2:]) <= 1.0]
            if len(near) >= 3:
                want |= {(f, q[1]): r[1] for q in near}
    assert got == {(r[0], r[1]): want.get((r[0], r[1]), -1) for r in rows}


def test_balls_do_not_depend_on_how_places_are_dealt(spark, monkeypatch):
    from visitlens.plans import grid

    rng = np.random.default_rng(8)
    rows = [(f, int(i), lat + round(float(a), 3), 7 + round(float(b), 3)) for i, (f, a, b) in enumerate(zip(rng.integers(0, 12, 900), rng.random(900) * 0.1, rng.random(900) * 0.1)) for f, lat in [(int(f), 9.0 if f % 2 else 65.0)]]
    rows += [(99, 5000, None, 7.0), (99, 5001, 9.0, 7.0), (7, 5001, float("nan"), 7.0), (50, 6000, 9.0, 180.0), (50, 6001, 9.0, -179.999), (50, 6002, 9.0, 179.999)]
    v = spark.createDataFrame(rows, "flw_id long, visit_id long, latitude double, longitude double")
    whole = {(r.flw_id, r.visit_id): r.cluster for r in ball_clusters(v.where("flw_id <> 50"), 1.0, 3).collect()}
    assert whole == {(r.flw_id, r.visit_id): r.cluster for r in ball_clusters(v.where("flw_id <> 50"), 1.0, 3, most=60).collect()}
    with monkeypatch.context() as m:  # components are for workers with very many places
        m.setattr(grid, "min_label_components", lambda *a, **b: 1 / 0)
        assert {r.cluster for r in ball_clusters(v, 1.0, 3).where("flw_id = 50").collect()} == {6000}
    want = {}
    for f in {r[0] for r in rows} - {50}:
        own = [r for r in rows if r[0] == f and r[2] is not None]
        for r in own:
            if want.setdefault((f, r[1]), -1) < 0:
                near = [q for q in own if want.get((f, q[1]), -1) < 0 and km(r[2:], q[2:]) <= 1.0]
                if len(near) >= 3:
                    want |= {(f, q[1]): r[1] for q in near}
    assert whole == want and len({c for (f, _), c in want.items() if f % 2 == 0}) > 5
    p = np.array([r[2:] for r in sorted(rows[:900])])
    start, first = np.array([True, *(a[0] != b[0] for a, b in zip(sorted(rows[:900])[1:], sorted(rows[:900]), strict=False))]), np.array([r[1] for r in sorted(rows[:900])])
    assert np.array_equal(*(grid.balls_of_groups(start, p, first, np.ones(900, np.int64), 1.0, 3, most) for most in (1, 1 << 22)))


def test_tours_go_to_the_nearest_place(spark):
    v = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    got = {(r.flw_id, str(r.visit_day)): (r.stops, r.km) for r in registry.queries()["udf_nearest_neighbour_tour"](spark, "/root/testdata/sf0.001").collect()}
    from visitlens.sources.views import visits

    days = {}
    for r in visits(spark, "/root/testdata/sf0.001").orderBy("visit_date", "visit_id").collect():
        days.setdefault((r.flw_id, str(r.visit_day)), []).append((r.latitude, r.longitude))
    assert v.count() == sum(map(len, days.values())) and got.keys() == days.keys()
    for key, places in days.items():
        at, left, way = places[0], places[1:], 0.0
        while left:
            far = [km(at, q) for q in left]
            i = int(np.argmin(far))
            way, at = way + far[i], left.pop(i)
        assert got[key][0] == len(places) and np.isclose(got[key][1], way, atol=1e-3)


def test_outlines(spark):
    square = np.array([(0, 0), (1, 0), (1, 1), (0, 1), (0.5, 0.5)], float)
    assert area_of(outline(square, 0.0)) == 1.0
    assert np.isclose(area_of(outline(square, 0.1, 720)), 1 + 4 * 0.1 + np.pi * 0.01, atol=1e-4)
    rows = [(1, 9 + i % 5 / 100, 7 + i // 5 / 100) for i in range(25)] + [(1, 20.0, 7.0)] + [(2, 9.0, 7.0)] * 3
    got = proxy_wards(spark.createDataFrame(rows, "k long, latitude double, longitude double"), "k", metres=0.0, most_km=75.0, least=10).collect()
    assert [(r.k, r.visits, r.used, r.corners) for r in got] == [(1, 26, 25, 4)] and np.isclose(got[0].area, 0.04 * 0.04)


def test_lonely_places(spark):
    rng = np.random.default_rng(4)
    rows = [(i % 2, i, 9 + round(float(a), 3), 7 + round(float(b), 3)) for i, (a, b) in enumerate(rng.random((80, 2)) * 0.1)] + [(0, 900, 12.0, 12.0), (0, 901, 12.0, 12.0), (1, 902, 12.0, 12.0)]
    got = {r.i for r in without_lonely(spark.createDataFrame(rows, "k long, i long, latitude double, longitude double"), "k", 500.0).collect()}
    assert got == {r[1] for r in rows if any(q[0] == r[0] and q[1] != r[1] and km(q[2:], r[2:]) <= 0.5 for q in rows)}


def test_dealt_folds_are_even(spark):
    df = spark.range(5000).select("id", (F.col("id") % 3 == 0).alias("y"))
    n = dealt_folds(df, "id", "y", 10).groupBy("y", "fold").count().toPandas().pivot(index="fold", columns="y", values="count")
    assert len(n) == 10 and n.to_numpy().sum() == 5000 and (n.max() - n.min()).max() <= 1


def test_streams_of_a_folder_and_of_nothing(spark, tmp_path):
    from visitlens.streaming.events import EVENTS, event_stream, run_to_table, tumbling

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(2).write.parquet(f"{tmp_path}/events.parquet")
    one, two = (pd.DataFrame(registry.queries()["strm_tumbling"](spark, d).collect()).sort_values([0, 1]).reset_index(drop=True) for d in ("/root/testdata/sf0.001", str(tmp_path)))
    assert len(one) > 0 and one.equals(two)
    spark.createDataFrame([], EVENTS).write.parquet(f"{tmp_path}/none/events.parquet")
    nothing = run_to_table(tumbling(event_stream(spark, f"{tmp_path}/none"), "1 day"), "append", "nothing")
    assert nothing.columns == ["window", "event_type", "n", "total", "epoch"] and nothing.count() == 0


def test_fold_scores_hold_every_worker(spark):
    rows = registry.queries()["ml_k_fold"](spark, "/root/testdata/sf0.001").toPandas()
    workers = rows["flw_id"].nunique()
    assert len(rows) == workers * 13 and (rows[rows["fold"].isin(list("0123456789"))].groupby("flw_id")["was_learnt"].sum() == 9).all()
    one = rows[rows["flw_id"] == rows["flw_id"].iloc[0]]
    own = one[one["fold"].str.isdigit()]["probability"]
    assert np.isclose(one[one["fold"] == "mean"]["probability"].iloc[0], own.mean(), atol=1e-5) and np.isclose(one[one["fold"] == "median"]["probability"].iloc[0], own.median(), atol=1e-5)


def test_numbered_points_are_read_as_they_are_spelt(spark, tmp_path):
    """Points with the spelling 'lattitude', and cases with whole and broken numbers."""
    from visitlens.functions.resolve import containing

    with open(f"{tmp_path}/points.csv", "w") as f:
        f.write("id,name,longitude,lattitude\n1,Point A,10.123,50.123\n2,Point B,11.234,51.234\n3,Point C,12.345,52.345\n")
    points = spark.read.csv(f"{tmp_path}/points.csv", header=True, inferSchema=True)
    lat, lon = containing(points.columns, ["lattitude", "latitude", "lat"]), containing(points.columns, ["longitude", "lon"])
    assert [tuple(r) for r in points.orderBy("id").select("id", lat, lon).collect()] == [(1, 50.123, 10.123), (2, 51.234, 11.234), (3, 52.345, 12.345)]


def test_reach_of_workers(spark, tmp_path):
    """Hulls equal those of all places of a worker at once; a visit without a place takes no part."""
    from visitlens.plans.grid import hull
    from visitlens.sources.views import visits

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.withColumn("props", F.when(F.col("event_id") % 10 != 0, F.col("props"))).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.flw_id: (r.n_corners, r.wkt) for r in registry.queries()["udf_convex_hull"](spark, str(tmp_path)).collect()}
    places = visits(spark, str(tmp_path)).where("latitude IS NOT NULL").select("flw_id", "longitude", "latitude").toPandas()
    want = {f: hull(g[["longitude", "latitude"]].to_numpy()) for f, g in places.groupby("flw_id")}
    assert got == {f: (len(h), "POLYGON ((" + ", ".join(f"{a:g} {b:g}" for a, b in [*h, h[0]]) + "))") for f, h in want.items()}


def test_boundaries_beyond_ninety_rows(spark):
    """Web coordinates end at 85 degrees; a larger table has more rows of cells than that."""
    import duckdb

    import __spark_entry__ as entry

    d, name = "/root/testdata/sf0.1", "src_geojson_polygons"
    sql = entry.oracle_sql()[name]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{d}/part.parquet'")
    got = registry.queries()[name](spark, d).toPandas()
    want = con.sql(sql).df()
    assert want["y1"].max() > 90
    assert sorted(map(tuple, got[want.columns].to_numpy().tolist())) == sorted(map(tuple, want.to_numpy().tolist()))
