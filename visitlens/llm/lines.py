"""Operator 7: line dedup. Runs of lines that an earlier place of the corpus has go; the first copy stays.

Documents are sequences of line ids (128 bits of hash). Lines that the corpus has once end every repeated run, so only
stretches of lines found twice or more take part, and of those only the ones with `least_words` words in all.

Their suffixes are sorted by distributed prefix doubling. Level 0 ranks the suffixes by their first line. Level k + 1 ranks
them by their first 2^(k+1) lines: each suffix pairs its rank at level k with that of the suffix 2^k lines on (0 beyond
the stretch), the distinct pairs are sorted over range partitions, and a pair's place in that order is the new rank. So a
level is the suffix array to that depth, and rows of one rank are an interval of it whose longest common prefix has 2^k
lines or more. Doubling ends with the deepest prefix that is asked for. The suffixes that share their first m lines, for
any m, are the interval where two intervals meet: that of the first 2^k lines and that of the last 2^k of the m lines.

A maximal repeated run counts if it has `least_words` words or more. It is the union of the shortest runs with that many
words that begin or end at each of its lines, so the intervals of these depths find all of them: of an interval's places
the first in the order of (doc_id, text hash, line) stays and the lines of all others are deleted.

Only what is rare is brought together: ranks go to suffixes by joins on distinct pairs, of which the frequent ones are
broadcast, and intervals are reduced to their first places where they lie.

Nulls: a null text stays null. Null ids come first. Rows that repeat both id and text are one document and get the same
result. Deleting all lines leaves an empty text. An empty table gives an empty result; other columns stay as they are.
Texts of any length are read whole; the lines of one document are one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.llm.common import fresh, in_turn, stored, table

LINES = "doc bigint, h bigint, ids array<bigint>, ids2 array<bigint>, words array<int>"
STRETCHES = "doc bigint, h bigint, start int, words array<int>, ranks array<bigint>"
WINDOWS = "doc bigint, h bigint, start int, length int, a bigint, b bigint"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _document(text: str = "text") -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)).cast("bigint")).alias("doc"), F.xxhash64(text).alias("h")]


def line_table(docs: DataFrame) -> DataFrame:
    """(doc, h, ids, ids2, words): both halves of the id, and the number of words, of every line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in in_turn(batches):
            ids, words, ends = [], [], [0]
            for text in batch.column(2).to_pylist():
                lines = text.split(b"\n")
                ids += map(digest, lines)
                words += [len(x.split()) for x in lines]
                ends.append(len(ids))
            at, halves = pa.array(ends, pa.int32()), np.frombuffer(b"".join(ids), "<i8").reshape(-1, 2)
            lists = (pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(words, pa.int32()))
            yield pa.record_batch([batch.column(0), batch.column(1), *(pa.ListArray.from_arrays(at, x) for x in lists)], names=_names(LINES))

    rows = docs.where(F.col("text").isNotNull()).select(*_document(), F.col("text").cast("binary").alias("text"))
    lines = stored(rows.mapInArrow(run, LINES), "lines")
    repeated = stored(lines.groupBy("doc", "h").agg(F.count("*").alias("n")).where("n > 1").select("doc", "h"), "repeated-documents")
    if repeated.isEmpty():
        return lines
    once = lines.join(repeated, ["doc", "h"], "left_semi").groupBy("doc", "h").agg(*(F.first(c).alias(c) for c in _names(LINES)[2:]))
    return stored(lines.join(repeated, ["doc", "h"], "left_anti").unionByName(once), "lines")


def _join_counted(left: DataFrame, counted: DataFrame, keys: list[str]) -> DataFrame:
    """left joined with counted, whose n says how many rows of left each of its keys has. Keys with a thousandth of these
    rows or more, at most a thousand keys, are broadcast, so that no task gets all rows of one; the others are shuffled."""
    total = counted.agg(F.sum("n")).first()[0] or 0
    least = max(2, total // 1000)
    hot, rest = F.broadcast(counted.where(F.col("n") >= least)), counted.where(F.col("n") < least)
    return left.join(hot, keys).unionByName(left.join(hot.select(keys), keys, "left_anti").join(rest, keys))


def ranked(counted: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """counted, a table of distinct keys, with `rank`: numbers that rise with the keys, from 1, over range partitions."""
    ordered = counted.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return stored(ordered.withColumn("rank", F.monotonically_increasing_id() + 1), tag)


def stretches(lines: DataFrame, least_words: int) -> DataFrame:
    """(sid, doc, h, start, words, ranks): the runs of lines that the corpus has twice or more, with the rank of each line."""
    each = lines.select("doc", "h", F.posexplode(F.arrays_zip("ids", "ids2")).alias("place", "x")).select("doc", "h", "place", F.col("x.ids").alias("id"), F.col("x.ids2").alias("id2"))
    twice = ranked(each.groupBy("id", "id2").agg(F.count("*").alias("n")).where("n > 1"), ["id", "id2"], "line-ranks")
    found = _join_counted(each, twice, ["id", "id2"]).groupBy("doc", "h").agg(F.collect_list(F.struct("place", "rank")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_turn(batches):
            out: list[tuple] = []
            for doc, h, words, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found.sort(key=lambda x: x["place"])
                at, counts = np.array([x["place"] for x in found]), np.array(words, np.int64)
                for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > 1) + 1):
                    a, b = int(at[part[0]]), int(at[part[-1]]) + 1
                    if counts[a:b].sum() >= least_words:
                        out.append((doc, h, a, words[a:b], [found[i]["rank"] for i in part]))
            c = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.record_batch([pa.array(x, k) for x, k in zip(c, kinds, strict=True)], names=_names(STRETCHES))

    rows = lines.select("doc", "h", "words").join(found, ["doc", "h"]).mapInArrow(run, STRETCHES)
    return stored(rows.withColumn("sid", F.monotonically_increasing_id()), "stretches")


def spans(words: np.ndarray, least_words: int) -> np.ndarray:
    """(start, length) of the shortest runs with least_words words that begin or end at each line of a stretch."""
    n, reach = len(words), np.concatenate([[0], np.cumsum(words)])
    i = np.arange(n)
    stop = np.searchsorted(reach, reach[:-1] + least_words)  # shortest run from i: lines i .. stop - 1
    first = np.searchsorted(reach, reach[1:] - least_words, side="right") - 1  # shortest run that ends with line i
    forward, backward = stop <= n, reach[1:] >= least_words
    return np.unique(np.concatenate([np.stack([i, stop - i], 1)[forward], np.stack([first, i + 1 - first], 1)[backward]]), axis=0)


def deepest(found: DataFrame, least_words: int) -> int:
    """The number of lines of the longest of these runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_turn(batches):
            most = max((int(spans(np.array(w, np.int64), least_words)[:, 1].max()) for w in batch.column(0).to_pylist()), default=0)
            yield pa.record_batch([pa.array([most], pa.int64())], names=["most"])

    return found.select("words").mapInArrow(run, "most bigint").agg(F.max("most")).first()[0] or 0


def doubled(level: DataFrame, step: int) -> DataFrame:
    """(sid, ranks) of the suffixes by twice as many lines; level: (sid, ranks) by `step` lines."""
    on = F.concat(F.slice("ranks", F.lit(step + 1), F.greatest(F.size("ranks") - step, F.lit(0))), F.array_repeat(F.lit(0).cast("bigint"), F.least(F.lit(step), F.size("ranks"))))
    pairs = level.select("sid", F.posexplode(F.arrays_zip(F.col("ranks").alias("r"), on.alias("s"))).alias("place", "x")).select("sid", "place", F.col("x.r").alias("r"), F.col("x.s").alias("s"))
    counted = ranked(pairs.groupBy("r", "s").agg(F.count("*").alias("n")), ["r", "s"], "pair-ranks")
    back = _join_counted(pairs, counted, ["r", "s"]).groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("place", "rank"))).alias("x"))
    return stored(back.select("sid", F.col("x.rank").alias("ranks")), "suffix-ranks")


def suffix_levels(found: DataFrame, depth: int) -> list[DataFrame]:
    """(sid, ranks) at each level whose prefixes have at most `depth` lines: 1, 2, 4, ..."""
    levels = [found.select("sid", "ranks")]
    while 1 << len(levels) <= depth:
        levels.append(doubled(levels[-1], 1 << (len(levels) - 1)))
    return levels


def suffix_array(docs: DataFrame, depth: int, least_words: int = 50) -> DataFrame:
    """(rank, doc, h, line) of every suffix of the stretches, in the order of their first lines, 2^k of them, 2^k <= depth."""
    found = stretches(line_table(docs), least_words)
    last = suffix_levels(found, depth)[-1].select("sid", F.posexplode("ranks").alias("i", "rank"))
    return last.join(found.select("sid", "doc", "h", "start"), "sid").select("rank", "doc", "h", (F.col("start") + F.col("i")).alias("line")).orderBy("rank", "doc", "h", "line")


def run_places(found: DataFrame, levels: list[DataFrame], least_words: int) -> DataFrame:
    """(doc, h, start, length, a, b): the shortest runs of each stretch and the two ranks that make the interval of each one."""
    together = found.select("sid", "doc", "h", "start", "words", F.col("ranks").alias("r0"))
    for k, level in enumerate(levels[1:], 1):
        together = together.join(level.select("sid", F.col("ranks").alias(f"r{k}")), "sid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_turn(batches):
            parts: list[np.ndarray] = []
            for doc, h, start, words, *ranks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = spans(np.array(words, np.int64), least_words)
                level = np.frexp(at[:, 1].astype(float))[1] - 1  # 2 ** level is the largest power of two in the length
                table_ = np.array(ranks, np.int64)
                a, b = table_[level, at[:, 0]], table_[level, at[:, 0] + at[:, 1] - (1 << level)]
                parts.append(np.stack([np.full(len(at), doc), np.full(len(at), h), at[:, 0] + start, at[:, 1], a, b], 1))
            rows = np.concatenate(parts) if parts else np.zeros((0, 6), np.int64)
            yield pa.record_batch([pa.array(rows[:, k]).cast(pa.int32()) if k in (2, 3) else pa.array(rows[:, k]) for k in range(6)], names=_names(WINDOWS))

    return together.drop("sid").mapInArrow(run, WINDOWS)


def repeated_lines(docs: DataFrame, least_words: int = 50) -> DataFrame:
    """(doc, h, gone): for each document that loses lines, whether each line goes, up to the last that does."""
    found = stretches(line_table(docs), least_words)
    windows = stored(run_places(found, suffix_levels(found, deepest(found, least_words)), least_words), "run-places")
    place = F.struct("doc", "h", "start")
    intervals = windows.groupBy("a", "b", "length").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    intervals = stored(intervals.where("n > 1"), "intervals")
    later = _join_counted(windows, intervals, ["a", "b", "length"]).where(place != F.col("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_turn(batches):
            masks = []
            for runs in batch.column(2).to_pylist():
                gone = np.zeros(max(r["start"] + r["length"] for r in runs), bool)
                for r in runs:
                    gone[r["start"] : r["start"] + r["length"]] = True
                masks.append(gone)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(masks, pa.list_(pa.bool_()))], names=["doc", "h", "gone"])

    runs = later.groupBy("doc", "h").agg(F.collect_list(F.struct("start", "length")).alias("runs"))
    return runs.mapInArrow(run, "doc bigint, h bigint, gone array<boolean>")


def _marked(docs: DataFrame, least_words: int) -> tuple[DataFrame, str]:
    """docs with the mask of the lines that go (null where none does), and the name of that column."""
    names = {x: fresh(docs, x) for x in ("doc", "h", "doc2", "h2", "gone")}
    found = repeated_lines(docs, least_words)
    gone = found.select(F.col("doc").alias(names["doc2"]), F.col("h").alias(names["h2"]), F.col("gone").alias(names["gone"]))
    doc, h = _document()
    keyed = docs.withColumns({names["doc"]: doc, names["h"]: h})
    same = (keyed[names["doc"]] == gone[names["doc2"]]) & (keyed[names["h"]] == gone[names["h2"]])
    return keyed.join(gone, same, "left").drop(*(names[x] for x in ("doc", "h", "doc2", "h2"))), names["gone"]


def _kept_text(gone: str) -> Column:
    lines = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.coalesce(F.get(gone, i), F.lit(False)))
    return F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(lines, "\n"))


def without_repeated_lines(docs: DataFrame, least_words: int = 50) -> DataFrame:
    """The documents with later copies of repeated runs taken out of their texts; n_chars, where there is one, follows."""
    marked, gone = _marked(docs, least_words)
    changed = {"text": _kept_text(gone)}
    if "n_chars" in docs.columns:
        length = F.length(_kept_text(gone)).cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(length)
    return marked.withColumns(changed).select(*docs.columns)


def lines_sql(least_words: int = 50) -> str:
    """The same rows by texts instead of names, every run compared as a whole. For tables with unique ids."""
    return f"""WITH l AS (SELECT doc_id, UNNEST(string_split(text, chr(10))) AS line, UNNEST(range(len(string_split(text, chr(10))))) AS i FROM documents),
c AS (SELECT doc_id, i, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n FROM l),
r AS (SELECT doc_id, i, line, SUM(n) OVER (PARTITION BY doc_id ORDER BY i) AS reach, SUM(n) OVER (PARTITION BY doc_id ORDER BY i) - n AS before FROM c),
w AS (SELECT a.doc_id, a.i AS s, MIN(b.i) AS e FROM r a JOIN r b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.reach >= a.before + {least_words} GROUP BY a.doc_id, a.i
  UNION SELECT b.doc_id, MAX(a.i), b.i FROM r a JOIN r b ON a.doc_id = b.doc_id AND b.i >= a.i AND a.before <= b.reach - {least_words} GROUP BY b.doc_id, b.i),
t AS (SELECT w.doc_id, s, e, array_to_string(string_split(text, chr(10))[s + 1 : e + 1], chr(10)) AS run FROM w JOIN documents d ON d.doc_id = w.doc_id),
p AS (SELECT *, MIN(doc_id) OVER (PARTITION BY run) AS first_doc FROM t),
q AS (SELECT *, MIN(s) OVER (PARTITION BY run, doc_id) AS first_s FROM p),
g AS (SELECT DISTINCT doc_id, UNNEST(range(s, e + 1)) AS i FROM q WHERE doc_id <> first_doc OR s <> first_s),
k AS (SELECT r.doc_id, COUNT(*) AS n_lines, COUNT(g.i) AS n_removed_lines, COALESCE(string_agg(line, chr(10) ORDER BY r.i) FILTER (WHERE g.i IS NULL), '') AS text FROM r LEFT JOIN g ON g.doc_id = r.doc_id AND g.i = r.i GROUP BY r.doc_id)
SELECT d.doc_id, k.text, COALESCE(n_lines, 0) AS n_lines, COALESCE(n_removed_lines, 0) AS n_removed_lines FROM documents d LEFT JOIN k USING (doc_id)"""


def op7_repeated_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked, gone = _marked(table(spark, sf_dir, "documents").select("doc_id", "text"), 50)
    return marked.select(
        "doc_id",
        _kept_text(gone).alias("text"),
        F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size(F.filter(gone, lambda x: x)), F.lit(0)).cast("bigint").alias("n_removed_lines"),
    )
