"""Operator 13: spelling variants, grouped by dense prefix-suffix tiling.

Words are runs of letters `[A-Za-z\\u00C0-\\u00FF]` with A-Z in lower case. Two words are near if one inserted, deleted or
replaced code point makes one into the other: that is so if the prefix and the suffix that they have in common together
reach the longer one's length less one. Then one of the two reaches half of that, so words are compared only with those
whose first or last half is the same (for both lengths that the longer of a pair can have). Words of one half are dealt to
tiles of at most about `tile` words; every pair of tiles is a task's piece of work however many words share a half. In a
piece the words are rows of two padded matrices of code points, one aligned left and one right; all rows are compared with
those a fixed number of rows further on, for one number after the other. A pair is counted where its prefixes meet if the
common prefix reaches half, else where its suffixes meet, and only sums by word leave a task.

A word's form is its near word of largest count, if that is `times` its own count or more; counts grow along forms, so
following them ends. Roots are found by doubling: in each round every word takes its form's form.

`slips` plants misspellings as the contract of the query has it; without it words are counted as they stand.

Nulls: a null text has no words; a null id is spelled `null`. Texts of any length are read whole, and words of any length
are compared whole. Words of equal count are taken in code-point order. Repeated rows count as often as they stand in the
table. An empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.llm.common import flat_text, ragged, steps, stored, table
from visitlens.llm.wordhash import HashTable, distinct, word_hashes, words_between

_B = np.arange(256)
_ASCII = ((_B | 32) >= 97) & ((_B | 32) <= 122) & (_B < 128)
_LOWER = np.where((_B >= 65) & (_B <= 90), _B + 32, _B).astype(np.uint8)
_PLACE = np.uint64(0x9E3779B97F4A7C15)
#: Words that a task holds before it sends their counts on, and pairs that one vectorised step compares.
_HELD, _PAIRS = 1 << 18, 1 << 16


def _crc_table() -> np.ndarray:
    """The remainder of each byte by the reflected polynomial of CRC-32."""
    t = _B.astype(np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


_CRC = _crc_table()


def crc32_of(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each span after bytes whose crc32 is `before`."""
    state = before.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    by = np.argsort(-lengths, kind="stable")
    state, at, left = state[by], starts[by], lengths[by]
    for k in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -k, side="left"))  # those longer than k
        s = state[:n]
        state[:n] = _CRC[(s ^ raw[at[:n] + k]) & np.uint32(0xFF)] ^ (s >> np.uint32(8))
    out = np.empty_like(state)
    out[by] = state ^ np.uint32(0xFFFFFFFF)
    return out


def letter_runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths in bytes and in code points, and documents of the maximal runs of letters in lower-cased UTF-8."""
    letter = _ASCII[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)  # U+00C0 to U+00FF are C3 80 to C3 BF
    letter[lead] = letter[lead + 1] = True
    starts, lengths, doc = words_between(~letter, offsets)
    tails = np.concatenate([[0], np.cumsum((raw & 0xC0) == 0x80)])
    return starts, lengths, lengths - (tails[starts + lengths] - tails[starts]), doc


def _slipped(word: bytes, h: int) -> bytes:
    text = word.decode()
    k = h % len(text)
    return (text[:k] + text[k + 1 :]).encode()


class _Counts:
    """Counts of words in a task, by 128 bits of hash."""

    def __init__(self):
        self.table = HashTable(_HELD)
        self.clear()

    def clear(self) -> None:
        self.table.clear()
        self.words, self.counts = [], np.zeros(self.table.capacity, np.int64)

    def add(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(starts), _HELD // 2):
            at, size = starts[a : a + _HELD // 2], lengths[a : a + _HELD // 2]
            h1, h2 = word_hashes(raw, at, size)
            first, inverse = distinct(h1, h2)
            if self.table.rows + len(first) > self.table.capacity:
                yield from self.sent()
            row = self.table.find(h1[first], h2[first])
            new = np.flatnonzero(row < 0)
            if len(new):
                row[new] = self.table.add(h1[first[new]], h2[first[new]])
                spans = size[first[new]]
                ends = np.concatenate([[0], np.cumsum(spans)])
                flat = raw[ragged(at[first[new]], spans)].tobytes()
                self.words += [flat[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            self.counts[row] += np.bincount(inverse, minlength=len(first))

    def sent(self) -> Iterator[pa.RecordBatch]:
        if self.words:
            word = pa.array(self.words, pa.binary()).cast(pa.string())
            yield pa.record_batch([word, pa.array(self.counts[: len(self.words)])], names=["word", "n"])
        self.clear()


def word_counts(docs: DataFrame, least_length: int = 6, slips: int | None = None) -> DataFrame:
    """(word, n) of every word of `least_length` code points or more. With slips: where that number divides the crc32 h of
    `<doc_id>:<word>`, the code point h modulo the word's length is taken out of it first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for batch in batches:
            raw, offsets = flat_text(batch.column(1))
            ids = batch.column(0).to_pylist()
            for a, b in steps(np.diff(offsets)):
                lower = _LOWER[raw[offsets[a] : offsets[b]]]
                starts, lengths, points, doc = letter_runs(lower, offsets[a : b + 1] - offsets[a])
                long = points >= least_length
                starts, lengths, points, doc = starts[long], lengths[long], points[long], doc[long]
                if slips:
                    before = np.array([zlib.crc32(f"{'null' if i is None else i}:".encode()) for i in ids[a:b]], np.uint32)
                    h = crc32_of(lower, starts, lengths, before[doc])
                    hit = h % slips == 0
                    words = [_slipped(lower[s : s + n].tobytes(), k) for s, n, k in zip(starts[hit].tolist(), lengths[hit].tolist(), h[hit].tolist(), strict=True)]
                    words = [w for w in words if len(w.decode()) >= least_length]
                    size = np.array([len(w) for w in words], np.int64)
                    yield from counts.add(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size)
                    starts, lengths = starts[~hit], lengths[~hit]
                yield from counts.add(lower, starts, lengths)
        yield from counts.sent()

    taken = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary"))
    return taken.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _pieces(words: DataFrame, tile: int) -> DataFrame:
    """(size, side, half, a, b, t, word, n): the words of each piece of work, a and b its two tiles, t the word's own."""
    length = F.char_length("word")
    either = words.select("word", "n", F.explode(F.array(length, length + 1)).alias("size"))
    reach = F.floor(F.col("size") / 2).cast("int")
    sides = F.array(F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), reach).alias("half")), F.struct(F.lit(1).alias("side"), F.expr("right(word, size div 2)").alias("half")))
    keyed = either.select("word", "n", "size", F.explode(sides).alias("s")).select("word", "n", "size", "s.side", "s.half")
    groups = keyed.groupBy("size", "side", "half").agg(F.count("*").alias("m"), F.max(F.char_length("word") == F.col("size")).alias("any")).where("m > 1 AND any")
    dealt = keyed.join(groups, ["size", "side", "half"]).withColumn("tiles", F.ceil(F.col("m") / tile)).withColumn("t", F.pmod(F.xxhash64("word"), "tiles"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1))
    paired = dealt.select("size", "side", "half", "t", "word", "n", other.alias("u"))
    return paired.select("size", "side", "half", F.least("t", "u").alias("a"), F.greatest("t", "u").alias("b"), "t", "word", "n")


def _matrices(words: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' code points aligned left and right in `size` columns, padded with 0, and their lengths."""
    raw = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    n = np.array([len(w) for w in words])
    row, ends = np.repeat(np.arange(len(n)), n), np.cumsum(n)
    col = ragged(np.zeros(len(n), np.int64), n)
    left, right = np.zeros((len(n), size), np.uint8), np.zeros((len(n), size), np.uint8)
    left[row, col] = raw[: ends[-1]]
    right[row, col + np.repeat(size - n, n)] = raw
    return left, right, n


def near_rows(left: np.ndarray, right: np.ndarray, n: np.ndarray, group: np.ndarray, tile: np.ndarray, across: np.ndarray, size: int, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of rows of one group (sorted) that are near; size: the longer one's length. Where `across`, the
    two must be of different tiles. Pairs with a common prefix of half the size are of side 0."""
    found, far, half = [], 1, size // 2
    last = np.searchsorted(group, group, side="right")
    rows = np.arange(len(group))
    while True:
        rows = rows[rows + far < last[rows]]
        if not len(rows):
            break
        for a in range(0, len(rows), max(1, _PAIRS * 8 // size)):
            i = rows[a : a + max(1, _PAIRS * 8 // size)]
            j = i + far
            ok = ((n[i] == size) | (n[j] == size)) & (~across[i] | (tile[i] != tile[j]))
            i, j = i[ok], j[ok]
            prefix = np.argmin(left[i] == left[j], axis=1)
            suffix = np.argmin((right[i] == right[j])[:, ::-1], axis=1)
            ok = (prefix + suffix >= size - 1) & ((prefix >= half) == (side[i] == 0))
            found.append((i[ok], j[ok]))
        far += 1
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def _near_in_pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(word, near, best_n, best) of the words of whole pieces: how many near words each has in them, and the best of these."""
    c = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names}
    out = []
    new = np.ones(len(c["size"]), bool)
    new[1:] = np.any([c[k][1:] != c[k][:-1] for k in ("size", "side", "half", "a", "b")], axis=0)
    piece = np.cumsum(new)
    for size in np.unique(c["size"]):
        at = np.flatnonzero(c["size"] == size)
        words = c["word"][at].tolist()
        i, j = near_rows(*_matrices(words, int(size)), piece[at], c["t"][at], (c["a"] != c["b"])[at], int(size), c["side"][at])
        if not len(i):
            continue
        one, two, n = np.concatenate([i, j]), np.concatenate([j, i]), c["n"][at]
        order = np.argsort(np.array(words))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        by = np.lexsort([rank[two], -n[two], one])
        first = np.ones(len(by), bool)
        first[1:] = one[by][1:] != one[by][:-1]
        best, count = two[by][first], np.bincount(one, minlength=len(at))[one[by][first]]
        out.append(pa.record_batch([pa.array([words[k] for k in one[by][first]], pa.string()), pa.array(count), pa.array(n[best]), pa.array([words[k] for k in best], pa.string())], names=["word", "near", "best_n", "best"]))
    return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out else None


def near_words(words: DataFrame, tile: int = 512, rows: int = 1 << 14) -> DataFrame:
    """(word, n_near, best) of the words that have near ones; best: (n, word) of the near word of largest n, then smallest.

    words: (word, n), distinct, of code points up to U+00FF. A vectorised step takes whole pieces, about `rows` rows of them.
    """
    keys = ["size", "side", "half", "a", "b"]
    dealt = _pieces(words, tile).repartition(*keys).sortWithinPartitions(*keys, "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held, count = [*held, batch], count + len(batch)
            if count < rows:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            last = {k: whole.column(k)[count - 1] for k in keys}
            cut = count
            while cut and all(whole.column(k)[cut - 1] == last[k] for k in keys):  # the last piece may go on in the next batch
                cut -= 1
            held, count = whole.slice(cut).to_batches(), count - cut
            if cut and (out := _near_in_pieces(whole.slice(0, cut).combine_chunks().to_batches()[0])):
                yield out
        if count and (out := _near_in_pieces(pa.Table.from_batches(held).combine_chunks().to_batches()[0])):
            yield out

    found = dealt.mapInArrow(run, "word string, near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("word")))
    sums = found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b"))
    return sums.select("word", "n_near", F.struct((-F.col("b.minus")).alias("n"), F.col("b.word").alias("word")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word of (word, form) whose form is not null: the end of its chain of forms.

    Counts grow at least `times` times along a chain, so rounds are logarithmic in the logarithm of the largest count.
    """
    linked = forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        step = linked.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = stored(linked.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        linked = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            return linked


def spelling_variants(docs: DataFrame, least_length: int = 6, least: int = 5, times: int = 5, slips: int | None = None, tile: int = 512) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of enough code points that occurs at least `least` times."""
    words = stored(word_counts(docs, least_length, slips).where(F.col("n") >= least), "spellings")
    found = words.join(near_words(words, tile), "word", "left")
    formed = F.col("best.n") >= times * F.col("n")
    grouped = stored(
        found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.word")).alias("form"), F.when(formed, F.col("best.n")).alias("form_n")),
        "forms",
    )
    return grouped.join(roots(grouped), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), slips=199)
