"""Operator 6: token ids as Re-Pair grammars, one for each block of a shard.

Documents are dealt by range of doc_id and sorted, so that the shards follow one another in ascending doc_id order. A
shard's documents are encoded and gathered into blocks of about `block_ids` ids. In each block pairs of neighbouring
symbols are replaced by nonterminals, round after round, until no pair has `least` places or more that don't overlap. A
round counts all pairs and gives every frequent one a nonterminal; where places overlap, the more frequent pair has its
way, and a pair that is left with fewer than `least` places waits for the next round. No pair crosses the end of a
document, so every document is a run of symbols of its own.

A block is a row of a Parquet table: the rules (two symbols each), the length each rule expands to, the sequence of
symbols, for each document its id, its number of ids and where its symbols end, and the lowest and highest id. Symbols are
32 bits wide and lie byte plane by byte plane, so that the file's codec shortens the small ones.

`read_ids` reads all documents back, `read_documents` some, `read_span` a range of ids. The last two open only the blocks
that hold what is asked for, and of these expand only that: symbol ends lead to a document, expansion lengths to a place.

Nulls: a null text is an empty one, null ids come first. Repeated rows stay, each with its own ids. An
empty table gives an empty result; extra columns are ignored. Texts of any length are encoded whole; a long one's ids
may stand in several blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from visitlens.llm.common import ragged, shared_dir, table
from visitlens.llm.tokens import encoder, tokenizer_path

BLOCKS = "part int, block int, vocab int, first_doc bigint, last_doc bigint, doc_ids array<bigint>, n_ids array<int>, symbol_ends array<int>, rounds array<int>, rules binary, rule_lengths array<int>, symbols binary"
_NAMES = [x.split()[0] for x in BLOCKS.split(", ")]
#: Where all symbols need no more bits than this, a pair and its place are sorted as one 64-bit number.
_RANK_BITS = 20
_NONE = np.uint64(2**64 - 1)


def planes(symbols: np.ndarray) -> bytes:
    """32-bit numbers, all lowest bytes first."""
    return np.ascontiguousarray(symbols.astype("<u4").reshape(-1).view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def _keys(left: np.ndarray, right: np.ndarray, stop: np.ndarray, at: np.ndarray, after: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(the pair that begins at each place of `at`, which of `at` begin two equal symbols). `at` holds all such places, `after` the
    places that follow. The pair is _NONE over a document's end (`stop`) and, in a run of one symbol, at every other place, so
    that places of one pair never overlap."""
    key = left.astype(np.uint64)
    key <<= np.uint64(bits)
    key |= right
    key[stop] = _NONE
    own = np.flatnonzero((left == right) & ~stop)
    fresh = np.concatenate([[True], at[own[1:]] != after[own[:-1]]])[: len(own)]
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(own)), 0))
    key[own[(np.arange(len(own)) - first) % 2 == 1]] = _NONE
    return key, own


def _pairs(seq: np.ndarray, last: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The same of symbols that lie side by side."""
    return _keys(seq[at], seq[at + 1], last[at], at, at + 1, 32)[0]


def _runs(s: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, first place, number of places) of the values with `least` places or more in sorted s, the most frequent last;
    ties by value."""
    at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])[: len(s)])
    n = np.diff(np.append(at, len(s)))
    enough = np.flatnonzero(n >= least)
    enough = enough[np.argsort(n[enough], kind="stable")]
    return s[at[enough]], at[enough], n[enough]


def _frequent(key: np.ndarray, least: int) -> np.ndarray:
    """The keys with `least` places or more, the most frequent last; ties by key."""
    return _runs(np.sort(key), least)[0]


def _ranked(key: np.ndarray, at: np.ndarray, least: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frequent pairs, the most frequent last; their places in any order; the rank of each place's pair, from 1). Symbols of a
    pair have `bits` bits each. Where these leave room for a place, one sort puts pairs and places in order. `key` may change."""
    room = 64 - 2 * bits
    if room and int(at[-1]) < (1 << room) - 1:
        none = key == _NONE
        key <<= np.uint64(room)
        key |= at.view(np.uint64)
        key[none] = _NONE
        key.sort()
        s = key[: np.searchsorted(key, _NONE)]
        pairs, first, n = _runs(s >> np.uint64(room), least)
        held = ragged(first, n)
        return pairs, (s[held] & np.uint64((1 << room) - 1)).view(np.int64), np.repeat(np.arange(1, len(pairs) + 1, dtype=np.int32), n)
    known = np.flatnonzero(key != _NONE)
    key, at = key[known], at[known]
    pairs = _frequent(key, least)
    order = np.argsort(pairs)
    rank = order[np.minimum(np.searchsorted(pairs, key, sorter=order), len(pairs) - 1)] if len(pairs) else np.zeros(0, np.int64)
    held = np.flatnonzero(pairs[rank] == key) if len(pairs) else rank
    return pairs, at[held], rank[held] + 1


def compress(ids: np.ndarray, ends: np.ndarray, vocab: int, least: int = 12):
    """(symbols, rules, expansion lengths, rules of each round, symbol ends) of ids whose documents end before `ends`.

    Places of old symbols never become more, so after the first round only places of pairs that were frequent, those beside a new
    symbol and those of two equal symbols are looked at. Symbols stay where they are, linked to the next and the one before, so
    that a round costs what it looks at.
    """
    size = len(ids)
    seq = np.append(ids, 0).astype(np.uint32)
    last = np.zeros(size + 1, bool)
    last[ends[ends > 0] - 1] = True
    after, before = np.arange(1, size + 2), np.arange(-1, size)  # place `size` is beyond both ends
    after[size], before[0] = size, size
    length = np.ones(vocab, np.int64)
    rules, per_round = [], []
    rank = np.zeros(size + 1, np.int32)
    alive = np.ones(size, bool)
    some = np.arange(size - 1)
    while len(some):
        bits = _RANK_BITS if len(length) <= 1 << _RANK_BITS else 32
        if rules:
            follow = after[some]
            key, same = _keys(seq[some], seq[follow], last[some], some, follow, bits)
        else:
            key, same = _keys(seq[:-2], seq[1:-1], last[:-2], some, after[:-2], bits)
        pairs, held, found = _ranked(key, some, least, bits)
        if not len(pairs):
            break
        rank[held] = found
        many = len(held) > size >> 5
        if many:  # in their order places lie near one another
            flags = rank != 0
            held = np.flatnonzero(flags)
        else:
            held = np.sort(held)
        found, follow = rank[held], after[held]
        won = np.flatnonzero((found > rank[before[held]]) & (found > rank[follow]))
        rank[held] = 0
        found = found[won] - 1
        chosen = np.bincount(found, minlength=len(pairs)) >= least  # the most frequent pair always is
        name = (len(length) - 1 + np.cumsum(chosen)).astype(np.uint32)
        kept = np.flatnonzero(chosen[found])
        found, won = found[kept], won[kept]
        at, gone = held[won], follow[won]
        seq[at] = name[found]
        last[at] = last[gone]
        alive[gone] = False
        after[at] = after[gone]
        before[after[at]] = at
        if many:
            flags[some[same]] = flags[before[at]] = True
            flags[gone] = flags[size] = False
            some = np.flatnonzero(flags)
        else:
            some = np.setdiff1d(np.concatenate([held, some[same], before[at]]), np.append(gone, size))
        pair = np.stack([pairs[chosen] >> np.uint64(bits), pairs[chosen] & np.uint64((1 << bits) - 1)], 1).astype(np.int64)
        length = np.concatenate([length, length[pair].sum(1)])
        rules.append(pair)
        per_round.append(len(pair))
    keep = np.flatnonzero(alive)
    seq, last = seq[keep], last[keep]
    stops = np.zeros(len(ends), np.int64)
    stops[ends > np.concatenate([[0], ends[:-1]])] = np.flatnonzero(last) + 1
    table_ = np.concatenate(rules).astype(np.uint32) if rules else np.zeros((0, 2), np.uint32)
    return seq, table_, length[vocab:], per_round, np.maximum.accumulate(stops)


class Grammar:
    """Expands symbols of a block."""

    def __init__(self, rules: np.ndarray, per_round: list[int], vocab: int):
        self.pool = np.arange(vocab, dtype=np.uint32)
        self.offset, self.count = np.arange(vocab, dtype=np.int64), np.ones(vocab, np.int64)
        done = 0
        for n in per_round:  # a rule only names symbols of earlier rounds
            flat = rules[done : done + n].astype(np.int64).ravel()
            text = self.expand(flat)
            size = self.count[flat].reshape(-1, 2).sum(1)
            self.offset = np.concatenate([self.offset, len(self.pool) + np.cumsum(size) - size])
            self.count = np.concatenate([self.count, size])
            self.pool = np.concatenate([self.pool, text])
            done += n

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        s = symbols.astype(np.int64)
        return self.pool[ragged(self.offset[s], self.count[s])]


def span_of(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, vocab: int, start: int, stop: int) -> np.ndarray:
    """Ids start .. stop - 1 of a run of symbols. Lengths lead to the symbols that hold them, and within these to the
    parts of their rules that do; nothing else is expanded."""
    size = lambda s: 1 if s < vocab else int(lengths[s - vocab])
    s = symbols.astype(np.int64)
    reach = np.concatenate([[0], np.cumsum(np.where(s < vocab, 1, lengths[np.maximum(s - vocab, 0)] if len(lengths) else 1))])
    a, b = int(np.searchsorted(reach, start, side="right")) - 1, int(np.searchsorted(reach, stop, side="left"))
    todo = [(int(s[i]), max(0, start - int(reach[i])), min(int(reach[i + 1]), stop) - int(reach[i])) for i in range(b - 1, a - 1, -1)]
    out: list[int] = []
    while todo:
        symbol, low, high = todo.pop()
        if symbol < vocab:
            out.append(symbol)
            continue
        left, right = (int(x) for x in rules[symbol - vocab])
        n = size(left)
        if high > n:
            todo.append((right, max(0, low - n), high - n))
        if low < n:
            todo.append((left, low, min(high, n)))
    return np.array(out, "<u4")


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, block_ids: int = 1 << 21, special: bool = True) -> None:
    """Writes the ids of every text, each followed by end_id, as a table of grammar blocks under path."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, special)
        vocab = max(len(enc.width) - 1, end_id + 1)
        part, held, number = TaskContext.get().partitionId(), [], 0

        def block() -> pa.RecordBatch:
            ids, n = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            doc_ids = pa.chunked_array([x[0] for x in held]).combine_chunks()
            symbols, rules, lengths, rounds, ends = compress(ids, np.cumsum(n), vocab)
            known = doc_ids.drop_null().to_numpy()
            low, high = (int(known.min()), int(known.max())) if len(known) else (None, None)
            row = [part, number, vocab, low, high, doc_ids.to_pylist(), n, ends, rounds, planes(rules), lengths, planes(symbols)]
            lists = [pa.list_(pa.int64())] + [pa.list_(pa.int32())] * 3
            types = [pa.int32()] * 3 + [pa.int64()] * 2 + lists + [pa.binary(), pa.list_(pa.int32()), pa.binary()]
            return pa.record_batch([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=_NAMES)

        for batch in batches:
            for a, ids, counts in enc.batches(batch.column(1)):
                n = counts + 1
                full = np.full(int(n.sum()), end_id, np.uint32)
                reach = np.cumsum(n)
                full[ragged(reach - n, counts)] = ids
                begin = 0
                while begin < len(n):  # documents in turn until a block is full
                    room = block_ids - sum(len(x[1]) for x in held)
                    base = int(reach[begin - 1]) if begin else 0
                    stop = int(np.searchsorted(reach, base + room, side="right"))
                    stop = max(stop, begin + (not held))
                    if stop > begin:
                        held.append((batch.column(0)[a + begin : a + stop], full[base : reach[stop - 1]], n[begin:stop]))
                    begin = stop
                    if begin < len(n) or sum(len(x[1]) for x in held) >= block_ids:
                        yield block()
                        held, number = [], number + 1
        if held:
            yield block()

    hashed = F.xxhash64("text")
    ranged = docs.select("doc_id", F.col("text").cast("binary").alias("text"), hashed.alias("h")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    ranged.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(blocks, BLOCKS).write.option("compression", "zstd").parquet(path)


def block_starts(spark: SparkSession, path: str, most: int = 100_000) -> DataFrame:
    """(part, block, base, size): the number of ids before each block and in it. Broadcast where there are `most` blocks or fewer."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    sizes = blocks.select("part", "block", F.aggregate("n_ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("size"))
    # One sum for each partition of the writing job comes to the driver, however many documents there are.
    totals = sorted((r.part, r.size, r.n) for r in sizes.groupBy("part").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect())
    bases, done = [], 0
    for part, size, _ in totals:
        bases.append((part, done))
        done += size
    base = spark.createDataFrame(bases, "part int, base bigint")
    before = F.coalesce(F.sum("size").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.join(F.broadcast(base), "part").select("part", "block", (F.col("base") + before).alias("base"), "size")
    return F.broadcast(starts) if sum(n for *_, n in totals) <= most else starts


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of a written table: ids as little-endian 32-bit integers, start: ids of all documents before."""
    return _read(spark, path, "doc_id bigint, start bigint, n_tokens bigint, ids binary", lambda raw: raw.tobytes(), pa.binary())


def _read(spark: SparkSession, path: str, schema: str, last, kind: pa.DataType) -> DataFrame:
    blocks, starts = spark.read.schema(BLOCKS).parquet(path), block_starts(spark, path).drop("size")
    names = [x.split()[0] for x in schema.split(", ")]

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grammar = Grammar(from_planes(row["rules"]).reshape(-1, 2), row["rounds"], row["vocab"])
                n = np.array(row["n_ids"], np.int64)
                reach = np.concatenate([[0], np.cumsum(n)])
                ids = grammar.expand(from_planes(row["symbols"])).astype("<u4", copy=False)
                values = [last(ids[a:b]) for a, b in zip(reach, reach[1:], strict=False)]
                yield pa.record_batch([pa.array(row["doc_ids"], pa.int64()), pa.array(row["base"] + reach[:-1], pa.int64()), pa.array(n, pa.int64()), pa.array(values, kind)], names=names)

    return blocks.join(starts, ["part", "block"]).mapInArrow(documents, schema)


def _parts(blocks: DataFrame, wanted) -> DataFrame:
    """(doc_id, start, ids): wanted(row) yields (document's place in the block, first and last + 1 of its ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rules, lengths, symbols = from_planes(row["rules"]).reshape(-1, 2), np.array(row["rule_lengths"], np.int64), from_planes(row["symbols"])
                ends, before, out = [0, *row["symbol_ends"]], np.concatenate([[0], np.cumsum(row["n_ids"])]), []
                for i, a, b in wanted(row):
                    ids = span_of(symbols[ends[i] : ends[i + 1]], rules, lengths, row["vocab"], a, b)
                    out.append((row["doc_ids"][i], row["base"] + int(before[i]) + a, ids.tobytes()))
                c = list(zip(*out, strict=True)) if out else [[]] * 3
                yield pa.record_batch([pa.array(x, t) for x, t in zip(c, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "start", "ids"])

    return blocks.mapInArrow(run, "doc_id bigint, start bigint, ids binary")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """As read_ids for the documents of a few ids: only blocks whose ids reach over one of them are opened."""
    asked = set(doc_ids)
    near = F.lit(False)
    for i in asked:
        near |= (F.col("first_doc") <= i) & (F.col("last_doc") >= i)
    blocks = spark.read.schema(BLOCKS).parquet(path).where(near).where(F.arrays_overlap("doc_ids", F.array(*map(F.lit, asked)).cast("array<bigint>")))
    found = blocks.join(block_starts(spark, path), ["part", "block"])
    return _parts(found, lambda row: ((i, 0, row["n_ids"][i]) for i, d in enumerate(row["doc_ids"]) if d in asked))


def read_span(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """(doc_id, start, ids) of the ids from start to stop - 1 in the order of the whole table, in a row for each document."""
    inside = block_starts(spark, path).where((F.col("base") < stop) & (F.col("base") + F.col("size") > start))

    def wanted(row: dict) -> Iterator[tuple[int, int, int]]:
        before = row["base"]
        for i, n in enumerate(row["n_ids"]):
            a, b = max(start - before, 0), min(stop - before, n)
            if a < b:
                yield i, a, b
            before += n

    return _parts(spark.read.schema(BLOCKS).parquet(path).join(inside, ["part", "block"]), wanted)


def id_digests(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint", zlib.crc32, pa.int64())


def op6_repair_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return id_digests(spark, path)
