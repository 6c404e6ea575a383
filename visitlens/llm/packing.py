"""Operator 10: packing documents into sequences of at most 1024 ids by cutting-stock column generation.

Every document is cut after each full sequence; what is left of it is an item of 1 to 1023 ids. The
histogram of item lengths is the demand of a cutting-stock problem: a pattern says how many items of
each length share a sequence. The linear program over patterns starts from patterns of one length;
a knapsack dynamic programme over the lengths' dual prices finds patterns that improve it, until the
bound it gives is near. Pattern counts are rounded down, the few items left are packed best fit first,
and the items of each length, ranked over all partitions, fill the patterns' places in turn. Only the
histogram (at most 1024 rows) and the plan (bounded by the number of lengths) pass the driver.

A sequence costs its padded length: 1024, or its own where that is a power of two.

Nulls: a null text is an empty one and yields its end id alone; null ids stay null. Repeated rows are
packed each for itself. An empty table gives an empty result; extra columns are ignored. Texts of any length are cut
into as many pieces as they need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visitlens.llm.common import ragged, stored, table
from visitlens.llm.tokens import encoder, tokenizer_path

PIECES = "part int, doc_id bigint, start bigint, length int, doc_tokens bigint, local_rank bigint, ids binary"


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 1024, special: bool = True) -> DataFrame:
    """Full sequences and the rest of every document, with ids (little-endian, 32 bits) and the rank of each
    piece among those of its length in its partition."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer, special), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for a, ids, counts in enc.batches(batch.column(1)):
                n = counts + 1
                full = np.full(int(n.sum()), end_id, "<u4")
                reach = np.cumsum(n)
                full[ragged(reach - n, counts)] = ids
                parts = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), parts)
                start = ragged(np.zeros(len(n), np.int64), parts) * capacity
                length = np.minimum(capacity, n[doc] - start)
                order = np.argsort(length, kind="stable")
                ranked = length[order]
                first = np.searchsorted(ranked, ranked)
                rank = np.empty(len(length), np.int64)
                rank[order] = np.arange(len(length)) - first
                rank += seen[length]
                seen += np.bincount(length, minlength=capacity + 1)
                offsets = np.concatenate([[0], np.cumsum(length) * 4]).astype(np.int64)
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(full)]).cast(pa.binary())
                doc_id = batch.column(0).slice(a, len(n)).take(pa.array(doc))
                yield pa.record_batch(
                    [pa.array(np.full(len(doc), part, np.int32)), doc_id, pa.array(start), pa.array(length.astype(np.int32)), pa.array(n[doc]), pa.array(rank), data],
                    names=[x.split()[0] for x in PIECES.split(", ")],
                )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text")).mapInArrow(cut, PIECES)


def _prices(y: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """best[c]: the highest sum of prices of items that fill c exactly; last[c]: an item of such a filling. y[s]: price of s."""
    best, last = np.full(capacity + 1, -np.inf), np.zeros(capacity + 1, np.int64)
    best[0] = 0.0
    for c in range(1, capacity + 1):
        v = y[1 : c + 1] + best[c - 1 :: -1][:c] if c > 1 else y[1:2] + best[:1]
        i = int(v.argmax())
        best[c], last[c] = v[i], i + 1
    return best, last


def _filling(last: np.ndarray, c: int) -> dict[int, int]:
    items: dict[int, int] = {}
    while c > 0:
        s = int(last[c])
        items[s] = items.get(s, 0) + 1
        c -= s
    return items


def padded(fill: int, capacity: int) -> int:
    return fill if fill & (fill - 1) == 0 else capacity


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Longest items first, each time the longest that still fits; uses up `left`."""
    plan: list[tuple[dict[int, int], int]] = []
    sizes = sorted((s for s in left if left[s]), reverse=True)
    while sizes:
        items, room = {}, capacity
        for s in sizes:
            k = min(left[s], room // s)
            if k:
                items[s] = k
                left[s] -= k
                room -= k * s
        times = 1 + min(left[s] // k for s, k in items.items())
        for s, k in items.items():
            left[s] -= k * (times - 1)
        plan.append((items, times))
        sizes = [s for s in sizes if left[s]]
    return plan


def fractional_patterns(demand: dict[int, int], capacity: int, gap: float = 5e-4, pivots: int = 8000) -> list[tuple[dict[int, int], float]]:
    """Patterns and their counts in the linear program, to within `gap` of its bound or after so many pivots."""
    sizes = np.array(sorted(demand))
    m, row = len(sizes), {int(s): i for i, s in enumerate(sizes)}
    b = np.array([demand[int(s)] for s in sizes], float)
    patterns: list[dict[int, int]] = [{int(s): capacity // int(s)} for s in sizes]
    cost = np.array([padded(s * k, capacity) / capacity for p in patterns for s, k in p.items()])
    inverse = np.diag([1.0 / p[int(s)] for s, p in zip(sizes, patterns, strict=True)])
    x = inverse @ b
    y = cost @ inverse
    powers = [1 << k for k in range(capacity.bit_length() - 1) if 1 << k < capacity]
    # Prices asked of the knapsack lie between those of the current basis and the best bound's so far, which
    # begins with the bare lengths: this keeps them from swinging. The first columns are a best-fit packing.
    steady = sizes / capacity
    done, bound, pull = 0, float(steady @ b), 0.8
    first = [(items, padded(sum(s * k for s, k in items.items()), capacity) / capacity) for items, _ in best_fit(dict(demand), capacity)]
    while done < pivots:
        asked = pull * steady + (1 - pull) * np.maximum(y, 0)
        price = np.full(capacity + 1, -np.inf)
        price[sizes] = asked
        best, last = _prices(price, capacity)
        ratio = max([best.max(), *(best[p] * capacity / p for p in powers)])
        here = float(asked @ b) / max(1.0, ratio)
        if here > bound:
            bound, steady = here, asked / max(1.0, ratio)
        if cost @ x <= bound * (1 + gap) or ratio <= 1 + 1e-9 and pull == 0 and y.min() > -1e-9:
            break
        # Besides the best filling, the best ones that hold each length, for many pivots by one programme.
        open_best = np.maximum.accumulate(best)
        where = np.zeros(capacity + 1, np.int64)
        where[1:] = np.maximum.accumulate(np.where(best[1:] >= open_best[1:], np.arange(1, capacity + 1), 0))
        gain = asked + open_best[capacity - sizes]
        tries = [*first, *((_filling(last, p), p / capacity) for p in powers if best[p] > -np.inf)]
        for i in np.argsort(-gain)[: max(20, m // 6)]:
            items = _filling(last, int(where[capacity - sizes[i]]))
            items[int(sizes[i])] = items.get(int(sizes[i]), 0) + 1
            tries.append((items, padded(sum(s * k for s, k in items.items()), capacity) / capacity))
        tries += [({int(sizes[i]): -1}, 0.0) for i in np.flatnonzero(y < -1e-9)]  # more of a length than is asked for
        moved = False
        for items, c in tries:
            rows_, counts = [row[s] for s in items], np.array(list(items.values()), float)
            reduced = c - y[rows_] @ counts
            if reduced > -1e-9:
                continue
            d = inverse[:, rows_] @ counts
            can = d > 1e-9
            if not can.any():
                continue
            steps = np.where(can, x / np.where(can, d, 1.0), np.inf)
            out = int(steps.argmin())
            t = steps[out]
            x -= t * d
            x[out] = t
            np.maximum(x, 0, out=x)
            inverse[out] /= d[out]
            pivot_row = inverse[out]
            other = d.copy()
            other[out] = 0
            inverse -= np.outer(other, pivot_row)
            y += reduced * pivot_row
            patterns[out], cost[out] = items, c
            done, moved = done + 1, True
        first = []
        if moved:
            pull = 0.8
        elif pull:
            pull = 0.4 if pull > 0.4 else 0.0
        else:
            break
    return [(p, float(n)) for p, n in zip(patterns, x, strict=True) if min(p.values()) > 0 and n >= 1 - 1e-9]


def packing_plan(demand: dict[int, int], capacity: int = 1024) -> list[tuple[dict[int, int], int]]:
    """(items by length, times) that use up the demand exactly."""
    plan: list[tuple[dict[int, int], int]] = []
    left = {s: n for s, n in demand.items() if n > 0}
    if full := left.pop(capacity, 0):
        plan.append(({capacity: 1}, full))
    if left:
        for items, n in fractional_patterns(left, capacity):
            times = min(int(n + 1e-9), *(left[s] // k for s, k in items.items()))
            if times > 0:
                plan.append((items, times))
                for s, k in items.items():
                    left[s] -= k * times
    return plan + best_fit(left, capacity)


def place(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to cut pieces (part, length, local_rank and any other columns)."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    demand = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, sequence, used = [], 0, dict.fromkeys(demand, 0)
    for items, times in packing_plan(demand, capacity):
        offset = 0
        for s, k in sorted(items.items(), reverse=True):
            slots.append((s, used[s], used[s] + k * times, k, sequence, offset))
            used[s] += k * times
            offset += s * k
        sequence += times
    plan = spark.createDataFrame(slots, "length int, low bigint, high bigint, each bigint, first_sequence bigint, first_offset int")
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("local_rank"))
    # The plan has a few thousand rows at most, whatever the number of documents.
    placed = ranked.join(F.broadcast(plan.withColumnRenamed("length", "of")), (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    at = F.col("rank") - F.col("low")
    return placed.withColumns(
        {
            "sequence_id": F.col("first_sequence") + F.floor(at / F.col("each")).cast("bigint"),
            "offset": F.col("first_offset") + (at % F.col("each")) * F.col("length"),
        }
    ).drop("part", "local_rank", "base", "rank", "of", "low", "high", "each", "first_sequence", "first_offset")


def packed_pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, capacity: int = 1024, special: bool = True) -> DataFrame:
    """One row per piece with its ids and its place."""
    return place(stored(cut_documents(docs, tokenizer or tokenizer_path(), end_id, capacity, special), "pieces"), capacity)


def packed_digests(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, capacity: int = 1024, special: bool = True) -> DataFrame:
    """As packed_pieces, with a checksum in place of the ids."""
    pieces = stored(cut_documents(docs, tokenizer or tokenizer_path(), end_id, capacity, special), "pieces")
    narrow = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return place(narrow, capacity).select(
        "doc_id", "start", F.col("length").cast("bigint").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", F.col("offset").cast("bigint").alias("offset")
    )


def op10_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digests(table(spark, sf_dir, "documents"))
