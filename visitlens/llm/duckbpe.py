"""Operator 12: byte-level BPE by recursive DuckDB queries in each partition, decoding by ordered aggregation.

A rank file gives every token its bytes and its rank, which is its id. Texts are split by the pattern of the file, each
match (a word here) on its own. In a task, the words that are new to its worker become rows (word, position, token) of an
in-memory DuckDB database that holds the merge table (pair of tokens, rank); a recursive query contracts each word's
leftmost pair of least rank until no pair of any word is in the table. A word that is a token as a whole is that token, as
in the tiktoken library. Ids are decoded by joining them to the tokens' bytes and aggregating these in order.

A word of more than `SHORT` bytes is first cut where no token that occurs in it lies across, which no merge can cross. What
is still long goes through a query that contracts in one step all places that single steps would contract next: the places
of the least rank, from the left, up to the first that makes a pair of lower rank.

Nulls: a null text is an empty one, with no ids and no bytes. Bytes that are no UTF-8 are read as U+FFFD. Texts of any
length are encoded whole, in runs of documents of about four megabytes, a longer text in a run of its own; they are decoded
in parts of `PART` ids. Null ids of documents and repeated rows stay, with one result for each row. An empty table gives an
empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.llm.common import flat_text, ragged, steps, table
from visitlens.llm.wordhash import WordCache

SHORT, PART = 64, 1 << 17
_LETTER, _NUMBER, _OTHER, _SPACE = range(4)
#: The code points with the property White_Space.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Words that one recursive query takes, and bytes of text that are split at a time.
_WORDS, _STEP = 1 << 15, 1 << 22

_LEFTMOST = """WITH RECURSIVE t(w, pos, tok, nx, npos, done) AS (
  SELECT w, pos, tok, CASE WHEN lead(w) OVER x = w THEN lead(tok) OVER x END, lead(pos) OVER x, false
  FROM words WINDOW x AS (ORDER BY w, pos)
  UNION ALL
  SELECT w, pos, tok, CASE WHEN lead(w) OVER x = w THEN lead(tok) OVER x END, lead(pos) OVER x, done FROM (
    SELECT t.w, t.pos, CASE WHEN t.pos = best // 256 % 256 THEN best >> 16 ELSE t.tok END AS tok, best IS NULL AS done
    FROM t LEFT JOIN (
      SELECT w, min((rank << 16) + pos * 256 + npos) AS best
      FROM t JOIN merges ON pair = t.tok << 32 | t.nx WHERE NOT done GROUP BY w) AS least ON t.w = least.w
    WHERE NOT t.done AND (best IS NULL OR t.pos <> best % 256))
  WINDOW x AS (ORDER BY w, pos))
SELECT w, pos, tok FROM t WHERE done"""

_ALL_NEXT = """WITH RECURSIVE t(w, pos, tok, done) AS (
  SELECT w, pos, tok, false FROM words
  UNION ALL
  SELECT * FROM (
    WITH s AS (
      SELECT w, pos, tok, row_number() OVER x AS i, lag(tok) OVER x AS before, lead(tok) OVER x AS nx, lead(tok, 2) OVER x AS after
      FROM t WHERE NOT done WINDOW x AS (PARTITION BY w ORDER BY pos)),
    p AS (SELECT s.*, rank, min(rank) OVER (PARTITION BY w) AS least FROM s LEFT JOIN merges ON pair = s.tok << 32 | s.nx),
    places AS (SELECT *, i - row_number() OVER (PARTITION BY w ORDER BY i) AS run FROM p WHERE rank = least),
    apart AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY i) AS nth FROM places) WHERE nth % 2 = 1),
    sides AS (
      SELECT w, i, least, after, CASE WHEN lag(i) OVER (PARTITION BY w ORDER BY i) = i - 2 THEN least ELSE before END AS before FROM apart),
    lower AS (
      SELECT sides.w, sides.i, least,
        sum(CASE WHEN a.rank < least OR b.rank < least THEN 1 ELSE 0 END)
          OVER (PARTITION BY sides.w ORDER BY sides.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stops
      FROM sides LEFT JOIN merges a ON a.pair = sides.before << 32 | least LEFT JOIN merges b ON b.pair = least << 32 | sides.after),
    taken AS (SELECT w, i, least FROM lower WHERE coalesce(stops, 0) = 0)
    SELECT p.w, p.pos, coalesce(one.least, p.tok), p.least IS NULL
    FROM p LEFT JOIN taken one ON one.w = p.w AND one.i = p.i LEFT JOIN taken two ON two.w = p.w AND two.i + 1 = p.i
    WHERE two.i IS NULL))
SELECT w, pos, tok FROM t WHERE done"""

_DECODE = """SELECT part, unhex(array_to_string(list(spelled ORDER BY pos), '')) AS bytes
FROM ids JOIN tokens USING (id) GROUP BY part ORDER BY part"""


def rank_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def class_table() -> np.ndarray:
    """Letter, number, other sign or white space, of every code point; what a letter is, the tiktoken library's patterns say."""
    import tiktoken

    of = np.full(0x110000, _OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}")):
        spelling = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        found = bytes(spelling.encode_ordinary(every)).decode()
        of[np.frombuffer(found.encode("utf-32-le"), "<u4")] = kind
    of[WHITE] = _SPACE
    return of


def byte_classes(raw: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The class of the character that each byte of UTF-8 belongs to."""
    out = of[:256][raw]
    lead = np.flatnonzero(raw >= 0xC0)
    if len(lead):
        wide = np.concatenate([raw, np.zeros(3, np.uint8)]).astype(np.int64)
        b = [wide[lead + k] for k in range(4)]
        size = 2 + (b[0] >= 0xE0) + (b[0] >= 0xF0)
        tail = [x & 63 for x in b[1:]]
        point = np.select(
            [size == 2, size == 3],
            [(b[0] & 31) << 6 | tail[0], (b[0] & 15) << 12 | tail[0] << 6 | tail[1]],
            (b[0] & 7) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2],
        )
        kind = of[point]
        for k in range(4):
            has = size > k
            out[lead[has] + k] = kind[has]
    return out


def words_of(raw: np.ndarray, offsets: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the matches of the pattern, which leave nothing out; none runs over the end of a text.

    A word is a run of letters, of numbers or of other signs, with a space that stands before it, or white space: all of a
    run of it at the end of a text, else all but its last character, which is on its own unless it is a space. An
    apostrophe that begins a word takes the endings s, t, m, d, re, ve and ll with it.
    """
    n = len(raw)
    kind = byte_classes(raw, of)
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    cut = begins.copy()
    cut[1:n] |= kind[1:] != kind[:-1]
    starts = np.flatnonzero(cut[:n])
    ends = np.append(starts[1:], n)
    inner = (kind[starts] == _SPACE) & ~begins[ends]
    starts, ends = starts[inner], ends[inner]
    last = ends - 1
    while ((raw[last] & 0xC0) == 0x80).any():
        last = last - ((raw[last] & 0xC0) == 0x80)
    cut[last] = True
    cut[ends[raw[last] == 32]] = False
    wide = np.concatenate([raw, np.zeros(3, np.uint8)])
    at = np.flatnonzero((raw == 39) & cut[:n])
    at = at[~begins[at + 1]]
    one = at[np.isin(wide[at + 1], list(b"stmd"))]
    pairs = wide[at + 1].astype(np.int64) << 8 | wide[at + 2]
    two = at[np.isin(pairs, [int.from_bytes(x) for x in (b"re", b"ve", b"ll")]) & ~begins[np.minimum(at + 2, n)]]
    for found, size in ((one, 2), (two, 3)):
        cut[found + 1] = False
        cut[found + size] = True
    starts = np.flatnonzero(cut[:n])
    return starts, np.diff(np.append(starts, n))


class DuckBpe:
    """Encodes and decodes by a rank file; `memory` bounds its DuckDB database, which writes no file."""

    def __init__(self, path: str, memory: str = "512MB", words: int = 1_500_000):
        import duckdb

        self.ranks = read_ranks(path)
        self.longest = max(map(len, self.ranks))
        self.first = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        merges = [(self.ranks[t[:k]], self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        left, right, rank = np.array(merges, np.int64).reshape(-1, 3).T
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": memory, "temp_directory": ""})
        for name, columns in (
            ("merges", {"pair": left << 32 | right, "rank": rank}),
            ("tokens", {"id": np.array(list(self.ranks.values()), np.int64), "spelled": [t.hex() for t in self.ranks]}),
        ):
            self.db.register("given", pa.table(columns))
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.classes = class_table()
        self.cache = WordCache(self._compute, np.int32, words)

    def _ask(self, sql: str, name: str, rows: pa.Table) -> pa.Table:
        self.db.register(name, rows)
        try:
            return self.db.sql(sql).to_arrow_table()
        finally:
            self.db.unregister(name)

    def contracted(self, words: list[bytes], sql: str = _LEFTMOST) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words end to end, from their single bytes on, and each one's number of ids."""
        ids, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a in range(0, len(words), _WORDS):
            part = words[a : a + _WORDS]
            sizes = np.array([len(w) for w in part])
            rows = {"w": np.repeat(np.arange(len(part)), sizes), "pos": ragged(np.zeros(len(part), np.int64), sizes), "tok": self.first[np.frombuffer(b"".join(part), np.uint8)]}
            got = self._ask(sql, "words", pa.table(rows))
            w, pos, tok = (got[c].to_numpy() for c in ("w", "pos", "tok"))
            ids.append(tok[np.lexsort([pos, w])])
            counts.append(np.bincount(w, minlength=len(part)))
        return np.concatenate(ids), np.concatenate(counts)

    def sure_parts(self, word: bytes) -> list[bytes]:
        """The word cut wherever no token that occurs in it lies across."""
        parts, begin, reach = [], 0, 0
        for i in range(len(word)):
            if i == reach and i:
                parts.append(word[begin:i])
                begin = i
            longest = next(k for k in range(min(self.longest, len(word) - i), 0, -1) if k == 1 or word[i : i + k] in self.ranks)
            reach = max(reach, i + longest)
        return [*parts, word[begin:]]

    def ids_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words end to end, and each one's number of ids."""
        known = np.array([self.ranks.get(w, -1) for w in words], np.int64)
        parts, of = [], []
        for i in np.flatnonzero(known < 0).tolist():
            own = [words[i]] if len(words[i]) <= SHORT else self.sure_parts(words[i])
            parts += own
            of += [i] * len(own)
        short = np.array([len(p) <= SHORT for p in parts], bool)
        spans, pool = np.zeros((2, len(parts)), np.int64), [known]
        for own, sql in ((np.flatnonzero(short), _LEFTMOST), (np.flatnonzero(~short), _ALL_NEXT)):
            ids, counts = self.contracted([parts[i] for i in own.tolist()], sql)
            spans[0, own], spans[1, own] = sum(map(len, pool)) + np.cumsum(counts) - counts, counts
            pool.append(ids)
        counts = np.where(known >= 0, 1, np.bincount(np.array(of, np.int64), spans[1], len(words)).astype(np.int64))
        # Parts stand in the order of their words; a known word is a span of its own.
        begins = np.concatenate([np.flatnonzero(known >= 0), spans[0]])
        sizes = np.concatenate([np.ones((known >= 0).sum(), np.int64), spans[1]])
        by = np.argsort(np.concatenate([np.flatnonzero(known >= 0), np.array(of, np.int64)]), kind="stable")
        return np.concatenate(pool)[ragged(begins[by], sizes[by])], counts

    def _compute(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        whole = raw.tobytes()
        ids, counts = self.ids_of([whole[a : a + n] for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)])
        return ids.astype(np.int32), counts

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and each text's number of ids."""
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        starts, lengths = words_of(raw, offsets, self.classes)
        row = self.cache.rows(raw, starts, lengths)
        counts = self.cache.count[row].astype(np.int64)
        reach = np.concatenate([[0], np.cumsum(counts)])
        return self.cache.pool[ragged(self.cache.offset[row], counts)], np.diff(reach[np.searchsorted(starts, offsets)])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> Iterator[list[bytes]]:
        """The bytes of each run of `counts` ids, in parts."""
        parts = -(-counts // PART)
        sizes = np.full(int(parts.sum()), PART)
        has = parts > 0
        sizes[(np.cumsum(parts) - 1)[has]] = (counts - (parts - 1) * PART)[has]
        ends, spelled = np.cumsum(sizes), []
        for a, b in steps(sizes, PART):
            own = ids[ends[a] - sizes[a] : ends[b - 1]]
            rows = {"part": np.repeat(np.arange(b - a), sizes[a:b]), "pos": np.arange(len(own)), "id": own.astype(np.int64)}
            spelled += self._ask(_DECODE, "ids", pa.table(rows))["bytes"].to_pylist()
        at = 0
        for n in parts.tolist():
            yield spelled[at : at + n]
            at += n

    def batches(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, counts) of runs of rows of a text column."""
        raw, offsets = flat_text(column)
        try:
            raw.tobytes().decode()
        except UnicodeDecodeError:
            raw, offsets = flat_text(pa.array([(x or b"").decode("utf-8", "replace").encode() for x in column.to_pylist()], pa.large_binary()))
        for a, b in steps(np.diff(offsets), _STEP):
            yield a, *self.encode(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


_OPEN: dict[str, DuckBpe] = {}


def opened(path: str) -> DuckBpe:
    """One for each worker process."""
    if path not in _OPEN:
        _OPEN[path] = DuckBpe(path)
    return _OPEN[path]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, ids, counts in opened(path).batches(batch.column(1)):
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids))
                yield pa.record_batch([batch.column(0).slice(a, len(counts)), lists], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary")).mapInArrow(run, "doc_id bigint, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, bytes) of rows (doc_id, ids); null ids make no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            spelled = [b"".join(parts) for parts in opened(path).decode(lists.flatten().to_numpy(zero_copy_only=False), counts)]
            yield pa.record_batch([batch.column(0), pa.array(spelled, pa.binary())], names=["doc_id", "bytes"])

    return rows.select(F.col("doc_id").cast("bigint"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id bigint, bytes binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text: encoded, then decoded from its ids, in one pass."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bpe = opened(path)
            for a, ids, counts in bpe.batches(batch.column(1)):
                ends = np.cumsum(counts)
                of_ids = [hashlib.sha256(ids[e - n : e].astype("<u4").tobytes()).hexdigest() for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                of_bytes = []
                for parts in bpe.decode(ids, counts):
                    digest = hashlib.sha256()
                    for part in parts:
                        digest.update(part)
                    of_bytes.append(digest.hexdigest())
                yield pa.record_batch([batch.column(0).slice(a, len(counts)), pa.array(counts), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names=names)

    taken = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary"))
    return taken.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op12_duckdb_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), rank_path())
