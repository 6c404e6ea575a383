"""Operator 3: quality rules as a learned decision list.

Statistics of every whole text are the attributes: the four counts of the base check and their rates, shares of letters,
digits, capitals, punctuation and distinct words, words and characters of its lines, its longest word, the entropy of its
bytes. Sequential covering learns ordered rules from labelled rows: a rule grows by the threshold that gains most
information about the rows it is to reject, is pruned against rows it did not grow on, and takes the rows it covers away
before the next one grows. Where good rows are left among those that a rule covers, a rule for these is grown in the same
way and stands before it, as its exception. Covering goes on while a rule of enough precision is found. The list becomes
one ordered Spark conditional expression; what no rule covers is kept.

A base check stands before the list: fewer than 50 words, or more than half of the words in repeated windows.

Nulls: a null text has no words and fails the base check. Labels outside the held-out fold are learnt from, at most
`rows` of them; with one class only, the list is empty and keeps what passes the base check. Repeated rows stay. An
empty table gives an empty result; extra columns stay in `with_statistics`, where the statistics get other names if a column
has theirs. Texts of any length are read whole, one at a time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitlens.llm.common import fresh, in_turn, table, training_rows

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_bytes", "n_letters", "n_digits", "n_capitals", "n_punctuation", "n_lines", "n_distinct", "longest_word", "entropy")
_LATER_BYTES = bytes(range(0x80, 0xC0))
_SYMBOLS = re.compile(rb"[#*$%&|<>]")
_B = np.arange(256)
_KINDS = {
    "n_letters": (((_B | 32) >= 97) & ((_B | 32) <= 122) & (_B < 128)) | (_B >= 0xC0),
    "n_digits": (_B >= 48) & (_B <= 57),
    "n_capitals": (_B >= 65) & (_B <= 90),
    "n_punctuation": np.isin(_B, list(b".,;:!?'\"()-")),
}


def statistics(text: bytes) -> tuple[float, ...]:
    """The counts of one text, in the order of STATISTICS and MORE. Characters are those that begin in a byte."""
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined) - (0 if joined.isascii() else len(joined) - len(joined.translate(None, _LATER_BYTES)))
    lines = text.split(b"\n")
    dup_lines = 0
    if len(set(lines)) < len(lines):
        seen = Counter(lines)
        dup_lines = sum(k - 1 for line, k in seen.items() if k > 1 and line.split())
    repeated = 0
    if n > 2:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        counts = Counter(windows)
        if len(counts) < len(windows):
            covered = -1
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    repeated += i + 3 - max(i, covered)
                    covered = i + 3
    byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    p = byte[byte > 0] / max(1, len(text))
    kinds = (int(byte[_KINDS[x]].sum()) for x in MORE[1:5])
    return n, chars, len(_SYMBOLS.findall(text)), dup_lines, repeated, len(text), *kinds, len(lines), len(set(words)), max(map(len, words), default=0), float(-(p * np.log2(p)).sum())


def with_statistics(docs: DataFrame, text: str = "text", name: str = "stats") -> DataFrame:
    """docs with a column of this name, a struct of all counts. No shuffle."""
    columns, fields = docs.columns, [*STATISTICS, *MORE]
    kinds = [T.DoubleType() if x == "entropy" else T.LongType() for x in fields]
    kind = T.StructType([T.StructField(x, k) for x, k in zip(fields, kinds, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_turn(batches, 2048):
            texts = batch.column(columns.index(text)).cast(pa.binary())
            rows = [statistics(x.as_py() or b"") for x in texts]
            parts = zip(*rows, strict=True) if rows else [[]] * len(fields)
            types = [pa.float64() if x == "entropy" else pa.int64() for x in fields]
            stats = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(parts, types, strict=True)], names=fields)
            yield pa.record_batch([*batch.columns, stats], names=[*columns, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, kind)]))


#: Attributes: a count, or a count for each of another (1 where that is 0).
ATTRIBUTES = {
    "n_words": ("n_words", None),
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_lines": ("n_dup_lines", None),
    "dup_lines_per_word": ("n_dup_lines", "n_words"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "letter_share": ("n_letters", "n_bytes"),
    "digit_share": ("n_digits", "n_bytes"),
    "capital_share": ("n_capitals", "n_bytes"),
    "punctuation_share": ("n_punctuation", "n_bytes"),
    "distinct_share": ("n_distinct", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
    "bytes_per_line": ("n_bytes", "n_lines"),
    "longest_word": ("longest_word", None),
    "entropy": ("entropy", None),
}
_NAMES = list(ATTRIBUTES)


def attributes(stats: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([stats[a] / (np.maximum(stats[b], 1) if b else 1.0) for a, b in ATTRIBUTES.values()], 1).astype(float)


def attribute_columns(stats: str = "stats") -> dict[str, Column]:
    of = lambda x: F.col(f"{stats}.{x}").cast("double")
    return {name: of(a) / F.greatest(of(b), F.lit(1.0)) if b else of(a) for name, (a, b) in ATTRIBUTES.items()}


@dataclass(frozen=True)
class Rule:
    """If every (attribute, above, threshold) holds, the text is good or not."""

    conditions: tuple[tuple[int, bool, float], ...]
    good: bool

    def covers(self, x: np.ndarray) -> np.ndarray:
        held = np.ones(len(x), bool)
        for a, above, t in self.conditions:
            held &= (x[:, a] > t) if above else (x[:, a] <= t)
        return held

    def __str__(self) -> str:
        return " and ".join(f"{_NAMES[a]} {'>' if above else '<='} {t:.6g}" for a, above, t in self.conditions) + f" -> {'keep' if self.good else 'reject'}"


def _grow(x: np.ndarray, y: np.ndarray, most: int) -> tuple[tuple[int, bool, float], ...]:
    """Adds the threshold with the highest information gain for the rows with y until only such rows are covered."""
    conditions: list[tuple[int, bool, float]] = []
    inside = np.ones(len(y), bool)
    while len(conditions) < most and not y[inside].all():
        p0, n0 = int(y[inside].sum()), int(inside.sum())
        if not p0:
            break
        best = (1e-9, None)
        for a in range(x.shape[1]):
            v, hit = x[inside, a], y[inside]
            order = np.argsort(v, kind="stable")
            v, hit = v[order], hit[order]
            cuts = np.flatnonzero(v[1:] > v[:-1])
            if not len(cuts):
                continue
            below = np.cumsum(hit)[cuts]
            for above, p, n in ((False, below, cuts + 1), (True, p0 - below, n0 - cuts - 1)):
                gain = p * (np.log2(np.maximum(p, 1e-9) / n) - np.log2(p0 / n0))
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (float(gain[i]), (a, above, float((v[cuts[i]] + v[cuts[i] + 1]) / 2)))
        if best[1] is None:
            break
        conditions.append(best[1])
        inside &= Rule((best[1],), True).covers(x)
    return tuple(conditions)


def _prune(conditions: tuple, x: np.ndarray, y: np.ndarray) -> tuple:
    """The shortest leading part that is worth most on rows the rule did not grow on."""
    worth = []
    for k in range(1, len(conditions) + 1):
        held = Rule(conditions[:k], True).covers(x)
        p, n = int((held & y).sum()), int((held & ~y).sum())
        worth.append((p - n) / (p + n) if p + n else -1.0)
    return conditions[: int(np.argmax(worth)) + 1] if worth else ()


def _rule(x: np.ndarray, y: np.ndarray, rows: np.ndarray, good: bool, precision: float, support: int, most: int, rng: np.random.Generator) -> Rule | None:
    """A rule for the rows of one class, grown on two thirds of `rows` and pruned on the rest, if it is right on `precision`
    of what it covers in both and covers `support` rows of its class."""
    at, wanted = rng.permutation(rows), y if good else ~y
    grow, prune = at[: 2 * len(at) // 3], at[2 * len(at) // 3 :]
    conditions = _prune(_grow(x[grow], wanted[grow], most), x[prune], wanted[prune])
    if not conditions:
        return None
    rule = Rule(conditions, good)
    parts = [wanted[part][rule.covers(x[part])] for part in (grow, prune)]
    enough = sum(int(p.sum()) for p in parts) >= support and all(len(p) and p.mean() >= precision for p in parts)
    return rule if enough else None


def decision_list(x: np.ndarray, y: np.ndarray, precision: float = 0.8, support: int = 5, most_conditions: int = 4, seed: int = 11) -> list[Rule]:
    """Rules in order, the first that covers a row decides; what none covers is kept. y: True for good rows.

    Covering ends when no rule against the rows left has `precision` and `support`, after three tries at other splits.
    """
    rng = np.random.default_rng(seed)
    rules, left, failed = [], np.ones(len(y), bool), 0
    while failed < 3 and (~y[left]).sum() >= support:
        rule = _rule(x, y, np.flatnonzero(left), False, precision, support, most_conditions, rng)
        if rule is None:
            failed += 1
            continue
        held = left & rule.covers(x)
        if (y & held).sum() >= support:
            but = _rule(x, y, np.flatnonzero(held), True, precision, support, most_conditions, rng)
            if but is not None:
                rules.append(Rule((*rule.conditions, *but.conditions), True))
        rules.append(rule)
        left &= ~held
    return rules


def base_failed(stats: str = "stats") -> Column:
    n = F.col(f"{stats}.n_words")
    return (n < 50) | (100 * F.col(f"{stats}.n_repeat_words") > 50 * n)


def verdict(rules: list[Rule], stats: str = "stats") -> Column:
    """The list as one conditional expression: the first rule whose conditions hold decides; otherwise the text is kept."""
    columns = attribute_columns(stats)
    out = F.when(base_failed(stats), F.lit(False))
    for r in rules:
        test = F.lit(True)
        for a, above, t in r.conditions:
            c = columns[_NAMES[a]]
            test = test & ((c > t) if above else (c <= t))
        out = out.when(test, F.lit(r.good))
    return out.otherwise(F.lit(True))


def learn_rules(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = 16_000) -> list[Rule]:
    """The decision list of at most `rows` labelled documents outside the held-out fold that pass the base check."""
    sample = with_statistics(training_rows(docs, labels, label, rows))
    got = sample.where(~base_failed()).select("stats.*", "y", "order", "doc_id").toArrow().sort_by([("order", "ascending"), ("doc_id", "ascending")])
    if not got.num_rows:
        return []
    return decision_list(attributes({c: got[c].to_numpy() for c in (*STATISTICS, *MORE)}), got["y"].to_numpy() == 1)


def passing_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    name = fresh(docs, "stats")
    return with_statistics(docs, name=name).where(verdict(learn_rules(docs, labels), name)).drop(name)


def op3_decision_list_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rules = learn_rules(docs, table(spark, sf_dir, "labels"))
    counts = [F.col(f"stats.{x}").alias(x) for x in STATISTICS]
    more = [F.round(c, 6).alias(name) for name, c in attribute_columns().items() if name not in STATISTICS]
    return with_statistics(docs).select("doc_id", *counts, base_failed().alias("base_failed"), verdict(rules).alias("kept"), *more)
