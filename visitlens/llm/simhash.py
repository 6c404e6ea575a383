"""Operator 8: near copies by SimHash, linked through pigeonhole blocks.

A fingerprint has 64 bits: those set in over half of the hashes of a text's word shingles. Fingerprints link at
`distance` or fewer differing bits. Equal fingerprints become one node first. The bits are split into blocks; a
pair that links has at least `blocks - distance` whole blocks in common, so every choice of that many blocks is a
key, and nodes meet in the buckets of their keys. A bucket yields a spanning forest of its links, found by
comparing whole fingerprints, never all its pairs. A bucket of more than `bucket` nodes is not opened: its nodes
are keyed again by 16 blocks, whose buckets hold at most 2 ** (4 * distance) values by construction. Components of
the forests' edges are those of all links. No join broadcasts a table, so what the driver holds does not grow with the input.

Nulls: a null text is an empty one; texts without words share fingerprint zero and link like any other. Null ids
take part and are never the smallest. Repeated rows stay, with one result each. An empty table gives an empty
result; extra columns are ignored. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.llm.common import fresh, in_turn, stored, table
from visitlens.llm.components import connected_components

_ROWS = 1 << 15


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """The SimHash of a text's word shingles; 0 where it has no word."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    stops = [x - 1 for x in accumulate(len(p) + 1 for p in parts)]
    starts = [0, *(x + 1 for x in stops[:-1])]
    n = max(1, len(parts) - words + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[:n], stops[min(words, len(parts)) - 1 :], strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for a in range(0, n, _ROWS):
        ones += np.unpackbits(hashes[a : a + _ROWS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42, also: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, fp) of every row, fp the fingerprint's bits as a signed 64-bit integer; `also`: further bigint columns."""
    also = also or {}
    names = ["doc_id", "fp", *also]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_turn(batches, 2048):
            fp = np.array([fingerprint(x or b"", words, seed) for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(fp), *batch.columns[2:]], names=names)

    taken = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text"), *(c.alias(name) for name, c in also.items()))
    return taken.mapInArrow(run, ", ".join(f"{name} bigint" for name in names))


def block_count(nodes: int, distance: int) -> int:
    """The fewest blocks with which a node meets less than about two others by chance in all its buckets."""
    for m in range(distance + 2, 16):
        if comb(m, distance) * nodes <= 2 * 2.0 ** (64 * (m - distance) // m):
            return m
    return 16


def _masks(blocks: int, distance: int) -> list[int]:
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    masks = [sum(c) for c in combinations(block, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _members(nodes: DataFrame, blocks: int, distance: int) -> DataFrame:
    """(which, key, n, fp): the buckets with more than one node, their sizes and their nodes."""
    masks = F.array(*(F.lit(m).cast("bigint") for m in _masks(blocks, distance)))
    keyed = nodes.select("fp", F.posexplode(masks).alias("which", "mask")).select("fp", "which", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    sizes = keyed.groupBy("which", "key").agg(F.count("*").alias("n")).where("n > 1")
    return keyed.join(sizes.hint("merge"), ["which", "key"])


def spanning_links(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints: each is visited once, with those not yet reached."""
    left, links = fps.view(np.uint64), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            f = queue.pop()
            near = np.bitwise_count(left ^ f) <= distance
            if near.any():
                links += [(f, g) for g in left[near]]
                queue += list(left[near])
                left = left[~near]
    return links


def _forests(buckets: DataFrame, distance: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, ends = batch.column(0).flatten().to_numpy(zero_copy_only=False), np.cumsum(batch.column(0).value_lengths().to_numpy(zero_copy_only=False))
            links = [x for a, b in zip(np.append(0, ends[:-1]), ends, strict=True) for x in spanning_links(flat[a:b], distance)]
            both = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["u", "v"])

    lists = buckets.groupBy("which", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
    return lists.mapInArrow(run, "u bigint, v bigint")


def links(nodes: DataFrame, distance: int = 4, bucket: int = 4096) -> DataFrame:
    """Edges (u, v) over distinct fingerprints whose components are those of all links."""
    members = stored(_members(nodes, block_count(nodes.count(), distance), distance), "buckets")
    edges = _forests(members.where(F.col("n") <= bucket), distance)
    crowded = members.where(F.col("n") > bucket).select("fp").distinct()
    if not crowded.isEmpty():
        edges = edges.unionByName(_forests(_members(crowded, 16, distance), distance))
    return edges


def _rooted(nodes: DataFrame, distance: int) -> DataFrame:
    """nodes, one row for each fingerprint, and the root of each one's component."""
    roots = connected_components(links(nodes, distance))
    return nodes.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id: the smallest id among the documents it is linked with."""
    rows = stored(fingerprints(docs, words, seed), "fingerprints")
    rooted = _rooted(stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes"), distance)
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(rooted.join(ids.hint("merge"), "root").select("fp", "component_id").hint("merge"), "fp")


def one_of_each_group(docs: DataFrame, words: int = 4, distance: int = 4, seed: int = 42) -> DataFrame:
    """Exactly one row of each component: that of the lowest id (null is the highest), of those the one of the lowest text hash,
    and of rows equal in both the one of the lowest hash of all columns, which tasks find before they send any.

    A row is known by its id and 128 bits of hash of its text, so rows of different components never compete, whatever ids they share.
    """
    key = {"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")}
    rows = stored(fingerprints(docs, words, seed, key), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *key)).alias("first")
    chosen = _rooted(stored(rows.groupBy("fp").agg(first), "nodes"), distance).groupBy("root").agg(F.min("first").alias("first"))
    own = {c: fresh(docs, c) for c in ("kept_id", *key)}
    chosen = chosen.select(*(F.col(f"first.{c}").alias(f"{own[k]}_") for c, k in (("doc_id", "kept_id"), *((c, c) for c in key))))
    hashed = docs.withColumns({own[c]: x for c, x in key.items()})
    same = hashed["doc_id"].cast("bigint").eqNullSafe(chosen[f"{own['kept_id']}_"])
    for c in key:
        same &= hashed[own[c]] == chosen[f"{own[c]}_"]
    row = fresh(hashed, "row")
    kept = hashed.join(chosen.hint("merge"), same, "left_semi").groupBy("doc_id", *(own[c] for c in key))
    return kept.agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias(row)).select(f"{row}.*")


def op8_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
