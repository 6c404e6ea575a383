"""Operator 11: hard negatives by spanning trees of anchors, whose edges bound the scores of what they reach.

A row's score is its inner product with an anchor, over whole numbers. Anchors are sorted by the signs of their products with
a few fixed directions and cut into blocks of `block`; each block gets a minimum spanning tree by distance. A candidate's
score at an anchor differs from that at the anchor's parent by at most the length of the edge times the candidate's norm.
So each block scores all candidates at its root, passes intervals along the tree, and scores anew only those candidates
whose interval meets a window that is still open: for positives, the scores from the anchor's k-th best on; for negatives,
the share of a positive's score, from the k-th best in it on. A score that is known narrows the intervals below it.

Candidates stay where they are read. Anchors come to them in passes of about `anchors` of them, each a broadcast of that
many vectors, so neither the driver nor a task ever holds all anchors. A task sends on, for each anchor and positive, the
best few that it has met; the best of these are the result. Intervals only save work: they are widened by more than rounding
can change, and every score that counts is a whole number, found as a double below 2 ** 52 and as a 64-bit integer beyond.

Nulls: rows with a null id, label or vector, or with a component that is null or not finite, take no part. Ties go to the
smaller id. A row that is repeated whole counts once; if different rows have one id, all of them take part and none is
another's positive or negative. Vectors of different lengths are read as if zeros stood at the end of the shorter one. An
anchor without positives or without negatives in a window has no rows. An empty table gives an empty result; extra columns
are ignored, whatever their names. There are no texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visitlens.llm.common import stored, table

#: Candidates that one step takes, directions that anchors are sorted by, and where doubles stop being exact (with room).
_STEP, _DIRECTIONS, _EXACT = 2048, 16, 2.0**52
_LEAST = np.iinfo(np.int64).min


def whole_vectors(rows: DataFrame, vec_id: Column, label: Column, vector: Column, scale: int = 256) -> DataFrame:
    """(vec_id, label, v): usable rows, each once, components scaled and rounded down."""
    usable = vec_id.isNotNull() & label.isNotNull() & vector.isNotNull()
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    v = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))
    return rows.where(usable & F.coalesce(finite, F.lit(False))).select(vec_id.cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), v.alias("v")).distinct()


def _matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """Lists as rows of whole numbers, with zeros at the end."""
    n = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(n), max(width, int(n.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1]) < n[:, None]] = flat
    return out


def spanning_tree(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, length) of a minimum spanning tree: the rows of v in the order they are reached from the one nearest
    to the mean, each one's parent and the edge to it."""
    x = v.astype(float)
    n = len(x)
    root = int(np.argmin(((x - x.mean(0)) ** 2).sum(1)))
    order, parent, length = [root], np.full(n, -1), np.zeros(n)
    near, nearest = np.sqrt(((x - x[root]) ** 2).sum(1)), np.full(n, root)
    near[root] = np.inf
    for _ in range(n - 1):
        i = int(np.argmin(near))
        order.append(i)
        parent[i], length[i], near[i] = nearest[i], near[i], np.inf
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        closer = (d < near) & np.isfinite(near)
        near[closer], nearest[closer] = d[closer], i
    return np.array(order), parent, length


def anchor_trees(anchors: DataFrame, block: int = 256, seed: int = 7) -> DataFrame:
    """(block, pos, parent, edge, vec_id, label, v): anchors in blocks, pos counting along each block's tree from its root."""
    names = ["block", "pos", "parent", "edge", "vec_id", "label", "v"]

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(2)).astype(float)
            directions = np.random.default_rng(seed).standard_normal((_DIRECTIONS, v.shape[1]))
            above = (v @ directions.T > 0) @ (1 << np.arange(_DIRECTIONS, dtype=np.int64))
            yield pa.record_batch([pa.array(above.astype(np.int64)), *batch.columns], names=["key", "vec_id", "label", "v"])

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = None, TaskContext.get().partitionId() << 32
        for batch in chain(batches, [None]):
            if batch is not None:
                held = pa.Table.from_batches([*(held.to_batches() if held is not None else []), batch])
            while held is not None and len(held) and (len(held) >= block or batch is None):
                own, held = held.slice(0, block).combine_chunks().to_batches()[0], held.slice(block)
                order, parent, length = spanning_tree(_matrix(own.column(3)))
                pos = np.empty(len(order), np.int64)
                pos[order] = np.arange(len(order))
                up = np.where(parent[order] < 0, -1, pos[parent[order]])
                own = own.take(pa.array(order))
                yield pa.record_batch([pa.array(np.full(len(order), number)), pa.array(np.arange(len(order))), pa.array(up), pa.array(length[order]), *own.columns[1:]], names=names)
                number += 1

    keyed = anchors.select("vec_id", "label", "v").mapInArrow(signs, "key bigint, vec_id bigint, label bigint, v array<bigint>")
    dealt = keyed.repartitionByRange("key", "vec_id").sortWithinPartitions("key", "vec_id", "label", "v")
    return dealt.mapInArrow(trees, "block bigint, pos bigint, parent bigint, edge double, vec_id bigint, label bigint, v array<bigint>")


@dataclass
class Anchors:
    """The anchors of a pass in tree order. windows: of each one, the (lowest, highest) scores that are looked for."""

    key: np.ndarray  # block and pos
    parent: np.ndarray
    edge: np.ndarray
    vec_id: np.ndarray
    label: np.ndarray
    v: np.ndarray
    windows: list[np.ndarray] = field(default_factory=list)

    @staticmethod
    def of(rows: pa.Table, windows: list[np.ndarray] | None = None) -> Anchors:
        c = {name: rows[name].to_numpy() for name in ("block", "pos", "parent", "edge", "vec_id", "label")}
        base = np.arange(len(rows)) - c["pos"]
        parent = np.where(c["parent"] < 0, -1, base + c["parent"])
        v = _matrix(rows["v"].combine_chunks()) if len(rows) else np.zeros((0, 0), np.int64)
        return Anchors(np.stack([c["block"], c["pos"]], 1), parent, c["edge"], c["vec_id"], c["label"], v, windows or [np.array([[_LEAST, -_LEAST - 1]])] * len(rows))


class Best:
    """The `size` best (score, id) of each window of each anchor that a task has met."""

    def __init__(self, windows: list[np.ndarray], size: int):
        self.size, self.windows = size, windows
        self.held = [[(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(w) for w in windows]
        self.low = [w[:, 0].copy() for w in windows]

    def put(self, a: int, score: np.ndarray, ids: np.ndarray) -> None:
        for k, (low, high) in enumerate(zip(self.low[a].tolist(), self.windows[a][:, 1].tolist(), strict=True)):
            fits = (score >= low) & (score <= high)
            if fits.any():
                s, i = (np.concatenate(x) for x in zip(self.held[a][k], (score[fits], ids[fits]), strict=True))
                by = np.lexsort([i, -s])[: self.size]
                self.held[a][k] = s[by], i[by]
                if len(by) == self.size:
                    self.low[a][k] = s[by[-1]]

    def rows(self, anchors: Anchors) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(self.held), 1024):
            found = [(*anchors.key[j].tolist(), k, s, i) for j in range(a, min(a + 1024, len(self.held))) for k, (ss, ii) in enumerate(self.held[j]) for s, i in zip(ss.tolist(), ii.tolist(), strict=True)]
            if found:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["block", "pos", "k", "score", "id"])


def search(best: Best, anchors: Anchors, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, same: bool) -> int:
    """Puts the candidates with the anchors' labels, or with other ones, in their windows. The number of scores found."""
    width = max(v.shape[1], anchors.v.shape[1])
    v, own = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (v, anchors.v))
    norm = np.sqrt((v.astype(float) ** 2).sum(1))
    exact = norm.max(initial=0) * np.sqrt((own.astype(float) ** 2).sum(1)).max(initial=0) < _EXACT
    v, own = (x.astype(float) for x in (v, own)) if exact else (v, own)
    slack = norm * (1 + 1e-9)
    bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    scored = 0
    for a in range(len(own)):
        p = anchors.parent[a]
        if not len(anchors.windows[a]):
            wanted = np.zeros(len(ids), bool)
        else:
            wanted = ((labels == anchors.label[a]) == same) & (ids != anchors.vec_id[a])
        if p < 0 or not exact:
            bounds = {} if p < 0 else bounds
            score = v @ own[a]
            lo = hi = score
            at = np.flatnonzero(wanted)
            score, scored = score[at], scored + len(ids)
        else:
            reach = anchors.edge[a] * slack + 1
            lo, hi = bounds[p][0] - reach, bounds[p][1] + reach
            if wanted.any():
                wanted &= (hi >= best.low[a].min()) & (lo <= anchors.windows[a][:, 1].max())
            at = np.flatnonzero(wanted)
            score = v[at] @ own[a]
            lo[at] = hi[at] = score
            scored += len(at)
        bounds[a] = lo, hi
        if len(at):
            best.put(a, score.astype(np.int64), ids[at])
    return scored


def _scan(rows: DataFrame, anchors, same: bool, size: int) -> DataFrame:
    """(block, pos, k, score, id): what each task finds best for window k of each anchor of a broadcast Anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = anchors.value
        best = Best(own.windows, size)
        for batch in batches:
            for a in range(0, len(batch), _STEP):
                part = batch.slice(a, _STEP)
                search(best, own, part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(part.column(2)), same)
        yield from best.rows(own)

    return rows.select("vec_id", "label", "v").mapInArrow(run, "block bigint, pos bigint, k bigint, score bigint, id bigint")


def _ranked(found: DataFrame, most: int) -> DataFrame:
    by = Window.partitionBy("block", "pos", "k").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, share: tuple[int, int] = (50, 95), block: int = 256, most_anchors: int = 1 << 14) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of anchors among vectors (vec_id, label, v).

    For each of an anchor's best `positives` rows of its label, the best `negatives` rows of other labels whose score is
    from share[0] to share[1] hundredths of the positive's. At most about `most_anchors` vectors are broadcast at a time.
    """
    spark = vectors.sparkSession
    vectors = stored(vectors, "vectors")
    trees = stored(anchor_trees(anchors, block), "anchors")
    passes = max(1, -(-trees.count() // most_anchors))
    out = None
    for k in range(passes):
        own = trees.where(F.pmod(F.xxhash64("block"), F.lit(passes)) == k)
        rows = own.orderBy("block", "pos").toArrow()
        sent = spark.sparkContext.broadcast(Anchors.of(rows))
        near = stored(_ranked(_scan(vectors, sent, True, positives), positives).select("block", "pos", F.col("rank").alias("k"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
        spans = near.where("positive_score >= 0").select("block", "pos", "k", *_window(share))
        found = spans.orderBy("block", "pos", "k").toArrow()
        place = {x: i for i, x in enumerate(zip(rows["block"].to_pylist(), rows["pos"].to_pylist(), strict=True))}
        at = np.array([place[x] for x in zip(found["block"].to_pylist(), found["pos"].to_pylist(), strict=True)], np.int64)
        spans = np.stack([found["low"].to_numpy(), found["high"].to_numpy()], 1)
        windows = np.split(spans, np.searchsorted(at, np.arange(1, len(rows)))) if len(rows) else []
        sent = spark.sparkContext.broadcast(Anchors.of(rows, windows))
        hard = _ranked(_scan(vectors, sent, False, negatives), negatives).withColumn("k", F.col("k") + 1)
        told = own.select("block", "pos", F.col("vec_id").alias("anchor_id"))
        part = hard.join(near, ["block", "pos", "k"]).join(told, ["block", "pos"])
        part = part.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        part = stored(part, "negatives") if passes > 1 else part
        out = part if out is None else out.unionByName(part)
    return out


def _window(share: tuple[int, int]) -> tuple[Column, Column]:
    """The lowest and highest whole scores in a share of a positive one that is not below zero."""
    score = F.col("positive_score").cast("decimal(20,0)")
    return F.ceil(score * share[0] / 100).cast("bigint").alias("low"), F.floor(score * share[1] / 100).cast("bigint").alias("high")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = whole_vectors(e, F.col("vec_id"), label, F.col("embedding"))
    rows = stored(rows, "whole")
    return hard_negatives(rows, rows.where(F.col("vec_id") % 50 == 0))


def negatives_sql() -> str:
    """The same rows by all products of anchors and rows."""
    return """WITH usable AS MATERIALIZED (
  SELECT * FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
whole AS MATERIALIZED (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM usable),
scores AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM whole a JOIN whole r ON a.vec_id % 50 = 0 AND r.vec_id <> a.vec_id),
near AS (
  SELECT anchor_id, id, score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k
  FROM scores WHERE same QUALIFY k <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INT) AS rank,
  s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM near p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3"""
