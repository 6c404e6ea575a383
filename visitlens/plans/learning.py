"""Fraud models, clustering, folds and made-up data."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visitlens.functions.columns import haversine_km
from visitlens.registry import query
from visitlens.sources.storage import saved
from visitlens.sources.views import answers, visits, with_views

FOLDS = 10
FEATURES = ["visits", "muac_mean", "muac_sd", "unwell_share", "rejected_share"]


def features(v: DataFrame) -> DataFrame:
    """Numeric features per worker, null where there are too few visits, and a label."""
    share = lambda c: F.count_if(c) / F.count("*")
    return v.groupBy("flw_id").agg(
        F.count("*").cast("double").alias("visits"), F.when(F.count("*") >= 55, F.avg("muac_cm")).alias("muac_mean"), F.when(F.count("*") >= 55, F.stddev_samp("muac_cm")).alias("muac_sd"),
        share(F.col("unwell") == "yes").alias("unwell_share"), share(F.col("status") == "rejected").alias("rejected_share"),
    ).withColumn("label", (F.col("flw_id") % 5 == 0).cast("double"))


def planted(v: DataFrame) -> DataFrame:
    """Visits in which one worker of five (those labelled) makes answers up: seven of ten measurements are the same, and half of
    the children are unwell. What a visit gets depends on its number alone."""
    chance = lambda n: (F.col("visit_id") * 7919 + F.col("flw_id") * 104729 + n) % 100
    fake = F.col("flw_id") % 5 == 0
    return v.withColumns({"muac_cm": F.when(fake & (chance(0) < 70), 12.5).otherwise(F.col("muac_cm")), "unwell": F.when(fake & (chance(37) < 50), "yes").otherwise(F.col("unwell"))})


def prepared() -> list:
    return [Imputer(strategy="median", inputCols=FEATURES, outputCols=[f"{c}_x" for c in FEATURES]), VectorAssembler(inputCols=[f"{c}_x" for c in FEATURES], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]


def balanced(df: DataFrame) -> DataFrame:
    n = F.broadcast(df.groupBy("label").agg(F.count("*").alias("own")).withColumn("weight", F.sum("own").over(Window.partitionBy()) / (2.0 * F.col("own"))).drop("own"))
    return df.join(n, "label")


@query("ml_random_forest")
def random_forest(spark: SparkSession, d: str) -> DataFrame:
    """Probabilities of a forest of a hundred trees of depth ten, classes weighted alike."""
    data = balanced(features(planted(visits(spark, d))))
    model = Pipeline(stages=[*prepared(), RandomForestClassifier(numTrees=100, maxDepth=10, seed=42, weightCol="weight")]).fit(data)
    return model.transform(data).select("flw_id", "label", F.round(vector_to_array("probability")[1], 6).alias("probability"))


@query("ml_logistic_regression")
def logistic_regression(spark: SparkSession, d: str) -> DataFrame:
    data = balanced(features(planted(visits(spark, d))))
    model = Pipeline(stages=[*prepared(), LogisticRegression(weightCol="weight", maxIter=100)]).fit(data)
    return model.transform(data).select("flw_id", "label", F.round(vector_to_array("probability")[1], 6).alias("probability"))


def dealt_folds(df: DataFrame, key: str, label: str, k: int) -> DataFrame:
    """df with a fold from 0 to k - 1 for each key (distinct): rows of a label are numbered in the order of a fixed hash and
    dealt in turn. The hash's high part splits a label into slices that are numbered apart, so that no task gets a whole class."""
    h = (F.col(key) * 2654435761) % 4294967296
    slices = df.withColumns({"h": h, "slice": F.floor(h / (1 << 24))})
    sizes = slices.groupBy(label, "slice").agg(F.count("*").alias("n"))  # 256 slices of a label at most
    before = F.coalesce(F.sum("n").over(Window.partitionBy(label).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(label, "slice", before.alias("before"))
    place = F.row_number().over(Window.partitionBy(label, "slice").orderBy("h", key))
    numbered = slices.withColumn("place", place).join(starts, [label, "slice"])
    return numbered.withColumn("fold", ((F.col("before") + F.col("place") - 1) % k).cast("bigint")).drop("h", "slice", "place", "before")


@query("ml_stratified_folds", with_views("f AS (SELECT DISTINCT flw_id, flw_id % 5 = 0 AS y FROM visits) SELECT flw_id, y, (ROW_NUMBER() OVER (PARTITION BY y ORDER BY (flw_id * 2654435761) % 4294967296, flw_id) - 1) % 10 AS fold FROM f"))
def stratified_folds(spark: SparkSession, d: str) -> DataFrame:
    """Ten folds with like shares of each class, by a fixed hash."""
    f = visits(spark, d).select("flw_id").distinct().withColumn("y", F.col("flw_id") % 5 == 0)
    return dealt_folds(f, "flw_id", "y", 10).select("flw_id", "y", "fold")


@query("ml_k_fold")
def k_fold(spark: SparkSession, d: str) -> DataFrame:
    """Ten models, each learnt without one fold, score every worker. One row for each worker and fold, with whether the model
    learnt from that worker, and for each worker the mean, the deviation and the median of the ten."""
    data = saved(dealt_folds(balanced(features(planted(visits(spark, d)))), "flw_id", "label", FOLDS), "folds")
    scored = None
    for k in range(FOLDS):  # one model for each fold, a fixed number
        model = Pipeline(stages=[*prepared(), LogisticRegression(weightCol="weight")]).fit(data.where(F.col("fold") != k))
        own = model.transform(data).select("flw_id", "label", F.lit(str(k)).alias("fold"), (F.col("fold") != k).alias("was_learnt"), vector_to_array("probability")[1].alias("probability"))
        scored = own if scored is None else scored.unionByName(own)
    scored = saved(scored, "fold-scores")
    over = scored.groupBy("flw_id", "label").agg(F.avg("probability").alias("mean"), F.stddev_samp("probability").alias("std"), F.percentile("probability", 0.5).alias("median"))
    summary = over.unpivot(["flw_id", "label"], ["mean", "std", "median"], "fold", "probability").withColumn("was_learnt", F.lit(None).cast("boolean"))
    return scored.unionByName(summary).withColumn("probability", F.round("probability", 6))


@query("ml_fold_scores")
def fold_scores(spark: SparkSession, d: str) -> DataFrame:
    """Area under the curve of each fold's model on the workers that it did not learn from, and their mean, deviation and median."""
    scored = k_fold(spark, d).where("was_learnt = false")
    # The share of pairs of one of each class in which the first has the higher score; ties count half. Scores are grouped first.
    steps = scored.groupBy("fold", "probability").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.partitionBy("fold").orderBy("probability").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    auc = steps.withColumn("below", below).groupBy("fold").agg(F.try_divide(F.sum(F.col("p") * (F.col("below") + F.col("q") / 2)), F.sum("p") * F.sum("q")).alias("auc"))
    over = auc.agg(F.avg("auc").alias("mean"), F.stddev_samp("auc").alias("std"), F.percentile("auc", 0.5).alias("median"))
    return auc.unionByName(over.unpivot([], ["mean", "std", "median"], "fold", "auc")).withColumn("auc", F.round("auc", 6))


def company(v: DataFrame, key: str, metres: float) -> DataFrame:
    """Places (key, latitude, longitude) of rows with another row of their key within so many metres, each with its number n of
    rows. A place of two rows needs no other, and the others look in the grid cells around them."""
    places = saved(v.groupBy(key, "latitude", "longitude").agg(F.count("*").alias("n")), "places")
    lat, lon = metres / 110_000, metres / 100_000
    cell = places.withColumns({"a": F.floor(F.col("latitude") / lat), "b": F.floor(F.col("longitude") / lon)})
    around = F.sequence(F.lit(-1), F.lit(1))
    spread = cell.where("n = 1").withColumn("a", F.explode(F.transform(around, lambda i: F.col("a") + i))).withColumn("b", F.explode(F.transform(around, lambda i: F.col("b") + i)))
    other = cell.select(key, "a", "b", F.col("latitude").alias("lat2"), F.col("longitude").alias("lon2"))
    km = haversine_km(F.col("latitude"), F.col("longitude"), F.col("lat2"), F.col("lon2"))
    close = spread.join(other, [key, "a", "b"]).where((km <= metres / 1000) & ((F.col("latitude") != F.col("lat2")) | (F.col("longitude") != F.col("lon2"))))
    return close.select(key, "latitude", "longitude", "n").distinct().unionByName(places.where("n > 1").select(key, "latitude", "longitude", "n"))


def without_lonely(v: DataFrame, key: str, metres: float) -> DataFrame:
    """Rows (key, latitude, longitude) with another row of their key within so many metres."""
    return v.join(company(v, key, metres), [key, "latitude", "longitude"], "left_semi")


def silhouettes(assigned: DataFrame) -> dict[int, float]:
    """For each k, the mean silhouette of squared distances over assigned (k, prediction, x, y, n): n points at a place, in a
    cluster. Sums of the clusters give every mean distance; a point alone in its cluster counts as zero."""
    sums = assigned.groupBy("k", "prediction").agg(F.sum("n").alias("w"), *(F.sum(F.col("n") * F.col(c)).alias(f"s{c}") for c in "xy"), F.sum(F.col("n") * (F.col("x") * F.col("x") + F.col("y") * F.col("y"))).alias("q"))
    table = F.broadcast(sums.groupBy("k").agg(F.collect_list(F.struct("prediction", "w", "sx", "sy", "q")).alias("clusters")))  # k clusters each
    square = F.col("x") * F.col("x") + F.col("y") * F.col("y")
    far = lambda c: F.greatest(F.lit(0.0), square + (c["q"] - 2 * (F.col("x") * c["sx"] + F.col("y") * c["sy"])) / c["w"])
    own = F.filter("clusters", lambda c: c["prediction"] == F.col("prediction"))[0]
    inner = far(own) * own["w"] / (own["w"] - 1)
    outer = F.array_min(F.transform(F.filter("clusters", lambda c: c["prediction"] != F.col("prediction")), far))
    value = F.when(own["w"] > 1, F.coalesce(F.try_divide(outer - inner, F.greatest(outer, inner)), F.lit(0.0))).otherwise(0.0)
    means = assigned.join(table, "k").groupBy("k").agg((F.sum(F.col("n") * value) / F.sum("n")).alias("s"))
    return {r.k: r.s for r in means.collect()}  # a row for each k


@query("ml_k_means")
def k_means(spark: SparkSession, d: str) -> DataFrame:
    """Places of the visits without those that are alone within five hundred metres, in two to ten clusters; the number with the
    best silhouette is marked. Models learn from places that weigh as many visits as they have."""
    v = visits(spark, d).where("latitude IS NOT NULL AND longitude IS NOT NULL")
    places = company(v.select(F.lit(0).alias("all"), "latitude", "longitude"), "all", 500.0).select("latitude", "longitude", F.col("n").cast("double").alias("n"))
    points = saved(VectorAssembler(inputCols=["latitude", "longitude"], outputCol="features").transform(places), "points")
    most = min(10, points.count() - 1)
    assigned = None
    for k in range(2, most + 1):  # nine models at most
        model = KMeans(k=k, seed=42, weightCol="n").fit(points)
        own = model.transform(points).select(F.lit(k).alias("k"), "prediction", F.col("latitude").alias("x"), F.col("longitude").alias("y"), "n")
        assigned = own if assigned is None else assigned.unionByName(own)
    scores = sorted(silhouettes(saved(assigned, "assigned")).items()) if assigned is not None else []
    best = max(scores, key=lambda x: x[1])[0] if scores else None
    return spark.createDataFrame([(k, round(s, 6), k == best) for k, s in scores], "k int, silhouette double, is_best boolean")


#: The field that each made-up worker answers in a way of its own, and how.
CHEATERS = {
    "glasses": ("yes", 1.0), "diarrhea": ("yes", 0.8), "diagnosed": ("yes", 0.6), "gender": ("male_child", 0.95), "unwell": ("yes", 0.7), "treated": ("yes", 0.5), "any_vaccine": ("yes", 0.9),
    "muac_colour": ("Red", 1.0), "dose_before": ("yes", 0.8), "recent_dose": ("yes", 0.75), "all_no": ("true", 0.9),
}
ROWS = 100


_OWN = ", ".join(f"('{f}', '{v}', {p}::DOUBLE, {k})" for k, (f, (v, p)) in enumerate(CHEATERS.items()))
_LONG = " UNION ALL ".join(f"SELECT '{f}' AS field, {k} AS i, {f} AS value FROM answers WHERE {f} <> ''" for k, f in enumerate(CHEATERS))


@query("ml_synthetic_workers", with_views(f"""l AS ({_LONG}), n AS (SELECT field, i, value, COUNT(*) AS n FROM l GROUP BY ALL), b AS (SELECT field, i, value, SUM(n) OVER w - n AS lo, SUM(n) OVER w AS hi, SUM(n) OVER (PARTITION BY field) AS total FROM n WINDOW w AS (PARTITION BY field ORDER BY value)),
r AS (SELECT range AS row FROM range({ROWS})), base AS (SELECT row, field, i, value FROM r JOIN b ON ((row * 7919 + i * 104729) % 10007) / 10007.0 >= lo / total AND ((row * 7919 + i * 104729) % 10007) / 10007.0 < hi / total), o AS (SELECT * FROM (VALUES {_OWN}) v(own, value, p, w))
SELECT w AS worker, own AS pattern, row, field, CASE WHEN field = own AND ((row * 6151 + w * 93911) % 10007) / 10007.0 < p THEN o.value WHEN field = own AND p < 1 AND base.value = o.value THEN 'other' ELSE base.value END AS value FROM base, o"""))
def synthetic_workers(spark: SparkSession, d: str) -> DataFrame:
    """Made-up workers, one for each field: the same hundred rows, whose answers are drawn from the baseline's shares, but in its
    own field each worker answers one thing far too often."""
    v = answers(spark, d)
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(k).alias("i"), F.col(f).alias("value")) for k, f in enumerate(CHEATERS)))
    n = v.select(F.inline(fields)).where("value IS NOT NULL AND value <> ''").groupBy("field", "i", "value").agg(F.count("*").alias("n"))
    w, every = Window.partitionBy("field").orderBy("value").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("field")
    b = n.select("field", "i", "value", ((F.sum("n").over(w) - F.col("n")) / F.sum("n").over(every)).alias("lo"), (F.sum("n").over(w) / F.sum("n").over(every)).alias("hi"))
    steps = b.groupBy("field", "i").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "value"))).alias("steps"))  # a field's few answers
    draw = ((F.col("row") * 7919 + F.col("i") * 104729) % 10007) / 10007.0
    rows = steps.select("field", "i", "steps", F.explode(F.sequence(F.lit(0), F.lit(ROWS - 1))).alias("row"))
    base = rows.select("row", "field", F.filter("steps", lambda s: (s["lo"] <= draw) & (draw < s["hi"]))[0]["value"].alias("value"))
    own = F.array(*(F.struct(F.lit(k).alias("worker"), F.lit(f).alias("pattern"), F.lit(x).alias("x"), F.lit(float(p)).alias("p")) for k, (f, (x, p)) in enumerate(CHEATERS.items())))
    every_worker = base.select("*", F.inline(own))
    mine, often = F.col("field") == F.col("pattern"), ((F.col("row") * 6151 + F.col("worker") * 93911) % 10007) / 10007.0 < F.col("p")
    value = F.when(mine & often, F.col("x")).when(mine & (F.col("p") < 1) & (F.col("value") == F.col("x")), "other").otherwise(F.col("value"))
    return every_worker.select("worker", "pattern", F.col("row").cast("bigint").alias("row"), "field", value.alias("value"))


@query("ml_feature_importance_rank")
def feature_importance(spark: SparkSession, d: str) -> DataFrame:
    """Importances of a forest, ranked with ties alike."""
    data = features(planted(visits(spark, d)))
    model = Pipeline(stages=[*prepared(), RandomForestClassifier(numTrees=20, maxDepth=5, seed=42)]).fit(data)
    rows = [(c, round(float(v), 9)) for c, v in zip(FEATURES, model.stages[-1].featureImportances.toArray(), strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double").withColumn("place", F.rank().over(Window.orderBy(F.desc("importance"))))
