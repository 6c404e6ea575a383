"""Operator 4: quality by naive Bayes support vectors.

A text's n-grams are those of one to three tokens, where a token is what a word looks like (letter case, length, the
signs it ends with, whether it repeats the word before) and, for single tokens, also the word itself. An n-gram counts
once for each document. Counts by class over the labelled rows give each n-gram its log-count ratio; a document is the
vector of its n-grams' ratios, and a linear hinge loss over these is fitted by dual coordinate descent. A logistic curve
over the margins of rows that were left out turns margins into scores.

Labels come from at most `rows` documents outside the held-out fold; every whole text is scored.

Nulls: a null text is an empty one, whose score is that of no n-grams. Null labels are not learnt from; with one class
only, the score is that class's share. Repeated rows stay, each scored; a repeated id is learnt from once. An empty table
gives an empty result. Extra columns stay in `with_quality`, one named like the score among them. Texts of any length are
read whole, those longer than half a megabyte in a step of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitlens.llm.common import flat_text, fresh, held_out, ragged, steps, stored, table, training_rows
from visitlens.llm.toxicity import curve, logistic
from visitlens.llm.wordhash import WordCache, word_hashes, words_between

BITS = 18
_B = np.arange(256)
_SPACE = np.isin(_B, [9, 10, 11, 12, 13, 32])
_UPPER = (_B >= 65) & (_B <= 90)
_LOWER = (_B >= 97) & (_B <= 122)
_DIGIT = (_B >= 48) & (_B <= 57)
_OTHER = (_B < 128) & ~_UPPER & ~_LOWER & ~_DIGIT
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        h = (h ^ p) * _M
        h ^= h >> np.uint64(31)
    return h


def word_looks(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hash of what a word looks like: case, length class, and the last three bytes where they are signs."""
    flat = raw[ragged(starts, lengths)]
    begin = np.cumsum(lengths) - lengths
    count = lambda kind: np.add.reduceat(kind[flat].astype(np.int64), begin)
    upper, lower, digit, other = count(_UPPER), count(_LOWER), count(_DIGIT), count(_OTHER)
    letters = lengths - digit - other
    case = np.select([letters == 0, (upper >= 2) & (lower == 0), upper == 0, _UPPER[raw[starts]] & (upper == 1)], [0, 1, 2, 3], 4)
    size = np.searchsorted([2, 4, 8, 16, 32], letters, side="right")
    stop = starts + lengths
    tail = np.zeros(len(starts), np.int64)
    run = np.ones(len(starts), bool)
    for k in range(1, 4):
        at = np.maximum(stop - k, 0)
        run &= (lengths >= k) & _OTHER[raw[at]]
        tail = np.where(run, tail * 256 + raw[at], tail)
    return _mix(*(x.astype(np.uint64) for x in (case + 1, size + 1, np.minimum(digit, 2), (other > 3).astype(np.int64), tail)))


class Grams:
    """Distinct n-gram buckets of documents; per-word hashes are computed once for each distinct word of a task."""

    def __init__(self):
        self.looks = WordCache(lambda raw, s, n: (np.stack([word_looks(raw, s, n), word_hashes(raw, s, n)[1]], 1).ravel(), np.full(len(s), 2)), np.uint64, 300_000)

    def buckets(self, raw: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(document, bucket) pairs, each once; wanted: which buckets matter."""
        starts, lengths, doc = words_between(_SPACE[raw], offsets)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        row = self.looks.rows(raw, starts, lengths)
        at = self.looks.offset[row]
        look, word = self.looks.pool[at], self.looks.pool[at + 1]
        same = np.zeros(len(row), np.uint64)
        same[1:] = (row[1:] == row[:-1]) & (doc[1:] == doc[:-1])
        token = _mix(look, same + np.uint64(1))
        keys, docs = [_mix(token, np.full(len(token), 1, np.uint64)), _mix(word, np.full(len(token), 4, np.uint64))], [doc, doc]
        for n in (2, 3):
            if len(token) >= n:
                inside = doc[n - 1 :] == doc[: len(doc) - n + 1]
                keys.append(_mix(*(token[k : len(token) - n + 1 + k] for k in range(n)), np.full(len(token) - n + 1, n, np.uint64))[inside])
                docs.append(doc[n - 1 :][inside])
        bucket, doc = (np.concatenate(keys) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(docs)
        if wanted is not None:
            keep = wanted[bucket]
            bucket, doc = bucket[keep], doc[keep]
        both = np.unique(doc << BITS | bucket)
        return both >> BITS, both & ((1 << BITS) - 1)


def gram_lists(rows: DataFrame, keep: str) -> DataFrame:
    """(keep, grams): the n-gram buckets of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Grams()
        for batch in batches:
            raw, offsets = flat_text(batch.column(1))
            for a, b in steps(np.diff(offsets)):
                doc, bucket = of.buckets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=b - a))]).astype(np.int32)
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), pa.array(bucket.astype(np.int32)))], names=[keep, "grams"])

    kind = rows.schema[keep].dataType.simpleString()
    return rows.select(keep, F.col("text").cast("binary").alias("text")).mapInArrow(run, f"{keep} {kind}, grams array<int>")


def dual_coordinate_descent(flat: np.ndarray, ends: np.ndarray, value: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 30, seed: int = 7, tolerance: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge loss; row i has value[f] at each f in flat[ends[i - 1]:ends[i]], y is 1 or -1."""
    w, bias, alpha = np.zeros(len(value)), 0.0, np.zeros(len(y))
    rows = np.split(flat, ends[:-1])
    values = [value[r] for r in rows]
    square = np.array([v @ v + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(y)):
            gradient = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                worst = max(worst, abs(new - alpha[i]) * square[i])
                alpha[i] = new
                w[rows[i]] += step * values[i]
                bias += step
        if worst < tolerance:
            break
    return w, bias


def squashed(margins: np.ndarray) -> np.ndarray:
    """Margins with far ones drawn in; the order stays, and no two become one."""
    return np.arcsinh(margins)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = 12_000, least: int = 2, cost: float = 0.02):
    """(weights of the buckets, bias, shape and weights of the logistic curve); only rows outside the held-out fold are read.

    An n-gram of fewer than `least` of the documents that the classifier learns from has no weight. All rows are put in the
    order of their hashed ids, so that a rerun learns the same on any number of partitions.
    """
    sample = training_rows(docs, labels, label, rows).select("text", F.struct("doc_id", "order", "y", (F.pmod("order", F.lit(4)) == 0).alias("calibrates")).alias("of"))
    lists = stored(gram_lists(sample, "of").select("of.*", "grams"), "quality-grams")
    counts = lists.where("not calibrates").select("y", F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"), F.sum("y").alias("good"))
    counts = stored(counts.where(F.col("n") >= least), "quality-counts")
    found = counts.toArrow()  # at most 2 ** BITS rows
    gram, n, good = (found[c].to_numpy() for c in ("gram", "n", "good"))
    size = 1 << BITS
    plus, minus = np.ones(size), np.ones(size)
    plus[gram] += good
    minus[gram] += n - good
    wanted = np.zeros(size, bool)
    wanted[gram] = True
    ratio = np.where(wanted, np.log(plus / plus[wanted].sum()) - np.log(minus / minus[wanted].sum()), 0.0) if len(gram) else np.zeros(size)
    allowed = F.broadcast(counts.select("gram"))
    kept = lists.select("doc_id", F.explode("grams").alias("gram")).join(allowed, "gram").groupBy("doc_id").agg(F.sort_array(F.collect_list("gram")).alias("grams"))
    got = lists.drop("grams").join(kept, "doc_id", "left").withColumn("grams", F.coalesce("grams", F.array().cast("array<int>"))).toArrow()
    got = got.sort_by([("order", "ascending"), ("doc_id", "ascending")]).combine_chunks()
    if not got.num_rows:
        return np.zeros(size), 0.0, (np.array([[0.0], [1.0]]), np.array([0.0, 0.0]))
    y, held = got["y"].to_numpy(), got["calibrates"].to_numpy()
    flat, ends = got["grams"].combine_chunks().flatten().to_numpy(), np.cumsum(got["grams"].combine_chunks().value_lengths().to_numpy())
    spans = np.concatenate([[0], ends])
    learn = np.flatnonzero(~held)
    sign = np.where(y == 1, 1, -1)[learn]
    share = np.array([(sign == -1).mean(), (sign == 1).mean()]).clip(1e-3)
    part = np.concatenate([flat[spans[i] : spans[i + 1]] for i in learn]) if len(learn) else flat[:0]
    w, bias = dual_coordinate_descent(part, np.cumsum(np.diff(spans)[learn]), ratio, sign, cost * 0.5 / share[(sign > 0).astype(int)]) if len(set(sign)) == 2 else (np.zeros(size), 0.0)
    w = w * ratio
    margins = np.add.reduceat(np.append(w[flat], 0.0), spans[:-1]) * (np.diff(spans) > 0) + bias
    use = held if len(set(y[held])) == 2 else np.ones(len(y), bool)
    if len(set(y[use])) < 2:
        p = float(np.clip(y.mean(), 0.01, 0.99))
        return np.zeros(size), 0.0, (np.array([[0.0], [1.0]]), np.array([0.0, np.log(p / (1 - p))]))
    return w, bias, logistic(squashed(margins[use])[:, None], y[use])


def with_quality(docs: DataFrame, model, name: str = "score", least: float | None = None, text: str = "text") -> DataFrame:
    """docs with a score column, or without it but only the rows whose score is at least `least`. No shuffle.

    Where docs has a column `name` itself, the score's name gets underscores at its end.
    """
    name = fresh(docs, name)
    w, bias, (shape, line) = model
    shared = docs.sparkSession.sparkContext.broadcast((w.astype(np.float32), w != 0))
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (weight, wanted), of = shared.value, Grams()
        for batch in batches:
            raw, offsets = flat_text(batch.column(columns.index(text)))
            scores = np.zeros(len(batch))
            for a, b in steps(np.diff(offsets)):
                doc, bucket = of.buckets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], wanted)
                margin = np.bincount(doc, weight[bucket].astype(float), b - a) + bias
                scores[a:b] = curve(squashed(margin)[:, None], shape, line)
            if least is None:
                yield pa.record_batch([*batch.columns, pa.array(scores)], names=[*columns, name])
            else:
                yield batch.filter(pa.array(scores >= least))

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())] if least is None else docs.schema.fields)
    return docs.mapInArrow(run, schema)


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents whose score is at least the threshold, with all their columns."""
    return with_quality(docs, train(docs, labels), least=threshold)


def op4_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = with_quality(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
