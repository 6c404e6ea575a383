"""Operator 1: toxicity by class-conditional Kneser-Ney models over the bytes of running text.

A text is read in lower case, every run of other ASCII signs as one space, so histories reach over the ends of words.
Two models, of toxic and of ordinary texts, give each byte its probability after `order` - 1 bytes of history. Only this
highest order is counted by class, with absolute discounting. What it discounts goes to one lower order that both classes
share: continuation counts of all shorter histories, discounted in turn. So an expression that is rare in either class
is judged by what is known of its parts, and one that is unknown to both says nothing.

The n-grams of all labelled texts outside the held-out fold are counted, those seen once included. A logistic curve turns
log-likelihood ratios, each divided by the number of bytes it is of, into a score: that of the whole text and the highest of
its passages of each length in `windows`. The curve is fitted on at most `rows` labelled documents, each read by models that
leave out the counts of its own part of `FOLDS`.

N-grams are of three bytes. Running text has 155 different ones (26 letters, the space, 128 that are not ASCII), so a model has
at most 155 ** 3 = 3,723,875 n-grams, which are broadcast, whatever the size of the tables: no score depends on it. A rerun gives
the same scores on any number of partitions.

Nulls: a null text is an empty one, and a text without bytes, or of ASCII signs only, has ratios of 0. Texts of any length are
read whole. Null labels are not learnt from; with no
rows of a class the score is 0.5 throughout. A repeated id counts as often as its rows stand in documents. Repeated rows
stay, each scored. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitlens.llm.common import flat_text, held_out, labelled_ids, ragged, steps, stored, table, texts_of
from visitlens.llm.wordhash import HashTable

ORDER, FOLDS = 3, 4
WINDOWS = (8, 16, 48)
_B = np.arange(256)
_SIGN = (_B < 128) & ~(((_B | 32) >= 97) & ((_B | 32) <= 122))
_SPACED = np.where(_SIGN, 32, _B).astype(np.uint8)
#: N-grams that a task holds before it sends their sums on.
_HELD = 1 << 20


def _low(k: int) -> np.uint64:
    return np.uint64((1 << 8 * k) - 1)


def running_text(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with one space for every run of signs, and their offsets."""
    x = _SPACED[raw]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
    begin = offsets[:-1]
    keep[begin[begin < len(x)]] = True
    return x[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def grams_of(x: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each byte of the running texts, its first byte lowest; spaces stand before a text."""
    sizes, lead = np.diff(offsets), order - 1
    at = np.cumsum(sizes + lead) - sizes
    marked = np.full(int(sizes.sum()) + lead * len(sizes) + 8, 32, np.uint8)
    places = ragged(at, sizes)
    marked[places] = x
    lanes = np.ndarray((len(marked) - 7,), dtype="<u8", buffer=marked.data, strides=(1,))
    return lanes[places - lead] & _low(order)


def _sums(group: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the sum of values in its group and the number of positive ones."""
    _, inverse = np.unique(group, return_inverse=True)
    return np.bincount(inverse, values)[inverse], np.bincount(inverse, values > 0)[inverse]


_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class ClassModels:
    order: int
    grams: np.ndarray
    gram_ratio: np.ndarray
    histories: np.ndarray
    history_ratio: np.ndarray

    def tables(self) -> list[tuple[HashTable, np.ndarray, np.uint64]]:
        """For n-grams and histories: a table of them, their values, and the bytes that count."""
        out = []
        for keys, values, size in ((self.grams, self.gram_ratio, self.order), (self.histories, self.history_ratio, self.order - 1)):
            found = HashTable(max(1, len(keys)))
            found.add(keys * _ODD, keys)
            out.append((found, values, _low(size)))
        return out

    def ratios(self, asked: np.ndarray) -> np.ndarray:
        """log p(byte | history, toxic) - log p(byte | history, ordinary) of each n-gram."""
        if "_tables" not in self.__dict__:
            self._tables = self.tables()
        out, todo = np.zeros(len(asked)), np.arange(len(asked))
        for found, values, mask in self._tables:
            key = asked[todo] & mask
            row = found.find(key * _ODD, key)
            hit = row >= 0
            out[todo[hit]] = values[row[hit]]
            todo = todo[~hit]
        return out


def kneser_ney(grams: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, order: int, discount: float = 0.75) -> ClassModels:
    """Log ratios from counts of distinct n-grams of the highest order by class."""
    by = np.argsort(grams)
    grams, counts = grams[by], [toxic[by].astype(float), ordinary[by].astype(float)]
    types, kinds_before = {}, {}
    above = grams
    for k in range(order - 1, 0, -1):  # how many different bytes stand before each shorter n-gram
        above, n = np.unique(above >> np.uint64(8), return_counts=True)
        types[k], kinds_before[k] = above, n.astype(float)
    shared = np.full(1, 1 / 256)
    for k in range(1, order):
        total, kinds = _sums(types[k] & _low(k - 1), kinds_before[k])
        below = shared[np.searchsorted(types[k - 1], types[k] >> np.uint64(8))] if k > 1 else 1 / 256
        shared = np.maximum(kinds_before[k] - discount, 0) / total + discount * kinds / total * below
    backoff = shared[np.searchsorted(types[order - 1], grams >> np.uint64(8))] if len(grams) else np.zeros(0)
    history = grams & _low(order - 1)
    logs, weights = [], []
    for c in counts:
        total, kinds = _sums(history, c)
        weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        logs.append(np.log(np.maximum(c - discount, 0) / np.maximum(total, 1) + weight * backoff))
        weights.append(np.log(weight))
    histories, first = np.unique(history, return_index=True)
    return ClassModels(order, grams, logs[0] - logs[1], histories, (weights[0] - weights[1])[first])


def _summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, *(np.bincount(inverse, np.concatenate([p[i] for p in parts]), len(keys)).astype(np.int64) for i in (1, 2))


def count_grams(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, toxic, ordinary), and fold where rows have one: how often each class's texts have each n-gram; rows: (text, y) or
    (text, y, fold). A task sums what it meets first. N-grams have seven bytes at most, the highest byte is the fold's."""
    folded = "fold" in rows.columns

    def sums(part: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(part[0].view(np.int64)), *map(pa.array, part[1:])], names=["gram", "toxic", "ordinary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            raw, offsets = flat_text(batch.column(0))
            y = batch.column(1).to_numpy(zero_copy_only=False)
            fold = batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint64) << np.uint64(56)
            for a, b in steps(np.diff(offsets)):
                x, at = running_text(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                toxic = np.repeat(y[a:b], np.diff(at))
                grams = grams_of(x, at, order) | np.repeat(fold[a:b], np.diff(at))
                held.append(_summed([(grams, toxic, 1 - toxic)]))
                if sum(len(h[0]) for h in held) > _HELD:
                    held = [_summed(held)]
                    if len(held[0][0]) > _HELD // 2:
                        yield sums(held.pop())
        if held:
            yield sums(_summed(held))

    text = F.lower("text").cast("binary").alias("text")
    given = rows.select(text, "y", F.col("fold").cast("int") if folded else F.lit(0).alias("fold"))
    counts = given.mapInArrow(run, "gram bigint, toxic bigint, ordinary bigint")
    if not folded:
        return _sum_by_gram(counts, "gram")
    gram = F.col("gram").bitwiseAND(F.lit((1 << 56) - 1))
    return _sum_by_gram(counts.select(gram.alias("gram"), F.shiftrightunsigned("gram", 56).cast("int").alias("fold"), "toxic", "ordinary"), "gram", "fold")


def _sum_by_gram(counts: DataFrame, *key: str) -> DataFrame:
    return counts.groupBy(*key).agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def models_of(counts: DataFrame, order: int, most_grams: int) -> ClassModels:
    """The models of the highest order that has at most `most_grams` n-grams, from a stored table of counts; operator 1 does not
    ask for this, as its order is fixed."""
    while order > 2 and counts.select("gram").distinct().count() > most_grams:
        counts, order = stored(_sum_by_gram(counts.withColumn("gram", F.shiftrightunsigned("gram", 8)), "gram"), "toxic-grams"), order - 1
    return fold_models(counts, order, 0)[0]


def fold_models(counts: DataFrame, order: int, folds: int) -> list[ClassModels]:
    """The models of all counts, then for each fold those of the counts of all others."""
    key = [c for c in ("gram", "fold") if c in counts.columns]
    got = counts.select(*key, *(F.col(c).cast("int") for c in ("toxic", "ordinary"))).toArrow()
    grams, at = np.unique(got["gram"].to_numpy().view(np.uint64), return_inverse=True)
    fold = got["fold"].to_numpy() if folds else np.zeros(len(at), np.int32)
    each = [got[c].to_numpy() for c in ("toxic", "ordinary")]
    total = [np.bincount(at, c, len(grams)) for c in each]
    out = [kneser_ney(grams, *total, order)]
    for k in range(folds):
        own = fold == k
        rest = [t - np.bincount(at[own], c[own], len(grams)) for t, c in zip(total, each, strict=True)]
        seen = rest[0] + rest[1] > 0
        out.append(kneser_ney(grams[seen], rest[0][seen], rest[1][seen], order))
    return out


def ratio_features(models: ClassModels, raw: np.ndarray, offsets: np.ndarray, windows: tuple[int, ...]) -> np.ndarray:
    """For each text its ratio for each byte, and the highest of a passage of each length (the whole text if it is shorter)."""
    x, at = running_text(raw, offsets)
    out, n = np.zeros((len(at) - 1, 1 + len(windows))), np.diff(at)
    signs_only = np.zeros(len(n), bool)
    signs_only[n == 1] = x[at[:-1][n == 1]] == 32
    has = np.flatnonzero((n > 0) & ~signs_only)
    if not len(has):
        return out
    # Whole numbers of 2 ** -32, so that a text's sums don't depend on the texts before it.
    reach = np.concatenate([[0], np.cumsum(np.rint(models.ratios(grams_of(x, at, models.order)) * 2.0**32).astype(np.int64))])
    out[has, 0] = (reach[at[1:]] - reach[at[:-1]])[has] / n[has] / 2.0**32
    for k, window in enumerate(windows):
        size = np.minimum(window, n[has])
        passages = n[has] - size + 1
        begin = ragged(at[:-1][has], passages)
        each = np.repeat(size, passages)
        out[has, k + 1] = np.maximum.reduceat((reach[begin + each] - reach[begin]) / each, np.cumsum(passages) - passages) / 2.0**32
    return out


def features(rows: DataFrame, models, windows: tuple[int, ...], keep: list[str], names: list[str], finish) -> DataFrame:
    """The columns `names` (double) that finish makes of each text's features, beside the columns `keep`; models: a broadcast ClassModels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = flat_text(batch.column(len(keep)))
            for a, b in steps(np.diff(offsets)):
                x = ratio_features(models.value, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], windows)
                yield pa.record_batch([*(c.slice(a, b - a) for c in batch.columns[: len(keep)]), *map(pa.array, finish(x))], names=[*keep, *names])

    taken = rows.select(*keep, F.lower("text").cast("binary").alias("text"))
    return taken.mapInArrow(run, T.StructType([*taken.schema.fields[: len(keep)], *(T.StructField(c, T.DoubleType()) for c in names)]))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """(centre and scale of the columns, weights with the constant last) by Newton steps."""
    shape = np.stack([x.mean(0), x.std(0) + 1e-9])
    while True:  # a higher ratio never lowers a score: a column with a negative weight is left out
        w = _newton(x, y, shape, ridge)
        if (w[:-1] >= 0).all():
            return shape, w
        shape = np.where(w[:-1] >= 0, shape, [[0.0], [np.inf]])


def _newton(x: np.ndarray, y: np.ndarray, shape: np.ndarray, ridge: float) -> np.ndarray:
    z = np.c_[(x - shape[0]) / shape[1], np.ones(len(x))]
    w, penalty = np.zeros(z.shape[1]), ridge * np.diag([*np.ones(x.shape[1]), 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(len(w)), z.T @ (y - p) - penalty @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def curve(x: np.ndarray, shape: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip((x - shape[0]) / shape[1] @ w[:-1] + w[-1], -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, rows: int = 4_000, order: int = ORDER, windows: tuple[int, ...] = WINDOWS, few: int = 1 << 21):
    """(broadcast models, shape and weights of the curve). The texts of all labelled ids are counted, those of at most `rows`
    ids are for the curve. `few` or fewer labelled ids are broadcast to the documents, more are shuffled to them."""
    spark = docs.sparkSession
    ids = stored(labelled_ids(labels, "toxic").withColumn("fold", F.pmod("order", F.lit(FOLDS)).cast("int")), "toxic-ids")
    counted = ids.select("doc_id", "y", "fold")
    counted = F.broadcast(counted) if ids.count() <= few else counted
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    counts = stored(count_grams(texts.join(counted, "doc_id"), order), "toxic-grams")
    whole, *parts = fold_models(counts, order, FOLDS)
    for_curve = stored(texts_of(docs, ids.orderBy("order", "doc_id").limit(rows)), "toxic-curve")
    names, seen = ["text_ratio", *(f"best_{w}" for w in windows)], []
    for k, part in enumerate(parts):
        sent = spark.sparkContext.broadcast(part)
        seen.append(features(for_curve.where(F.col("fold") == k), sent, windows, ["doc_id", "order", "y"], names, lambda x: x.T).toArrow())
        sent.unpersist()
    seen = pa.concat_tables(seen).sort_by([("order", "ascending"), ("doc_id", "ascending")])
    x, y = np.stack([seen[c].to_numpy() for c in names], 1), seen["y"].to_numpy()
    line = logistic(x, y) if len(np.unique(y)) == 2 else (np.stack([np.zeros(len(names)), np.ones(len(names))]), np.zeros(len(names) + 1))
    return spark.sparkContext.broadcast(whole), *line


def toxicity(docs: DataFrame, labels: DataFrame, windows: tuple[int, ...] = WINDOWS, **learning) -> DataFrame:
    """(doc_id, score, text_ratio, best_ratio) of every text; `learning` as in `learn`."""
    models, shape, w = learn(docs, labels, windows=windows, **learning)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return features(rows, models, windows, ["doc_id"], ["score", "text_ratio", "best_ratio"], lambda x: (curve(x, shape, w), x[:, 0], x[:, 1:].max(1)))


def op1_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "text_ratio", "best_ratio")
