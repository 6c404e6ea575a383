"""Operator 5: licence scans by a positional index of rare words, in DataFrame functions only.

Every template (a licence's tell-tale passage) is indexed under its highest-IDF words, IDF being taken over the
templates: an entry says which template has the word and where. A text's words are looked up in that index; a word at
place i that a template has at place j proposes the alignment i - j. Each proposed alignment is intersected with the
template's other words by relative position, which gives the share of its IDF weight that is there, and then the
template's mandatory key phrase is verified at its place. Alignments are a text's own, so no row meets another: one
pass over the table, no shuffle, and work in proportion to the words and to the rare words found.

The three base phrases are templates whose key phrase is all of them.

Nulls: a null text is an empty one, with no words, no places and empty labels. Repeated rows stay, each with its result;
a text that repeats a phrase counts every place. Templates that reach over a text's start or end match by what is there.
An empty table gives an empty result; extra columns are ignored. Texts of any length are read whole, as arrays of their words.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.llm.common import table


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_at(self) -> int:
        w, k = self.words, self.key.split()
        return next(i for i in range(len(w)) if w[i : i + len(k)] == k)


BASE = (
    Template("cc-by", "cc by", "cc by", True),
    Template("gpl", "general public license", "general public license", True),
    Template("reserved", "all rights reserved", "all rights reserved", True),
)
TEMPLATES = (
    *BASE,
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    Template("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("gpl-notice", "free software you can redistribute it and or modify it under the terms of the gnu general public license", "you can redistribute it and or modify it"),
    Template("lgpl", "the gnu lesser general public license", "lesser general public license"),
    Template("agpl", "the gnu affero general public license", "affero general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc0", "cc0 1 0 universal public domain dedication", "public domain dedication"),
    Template("unlicense", "free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    Template("copyright", "copyright all rights reserved", "all rights reserved"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"
_SHIFT = 1 << 12


def idf(templates: tuple[Template, ...]) -> dict[str, float]:
    words = [set(t.words) for t in templates]
    return {w: log((len(words) + 1) / sum(w in x for x in words)) for w in set().union(*words)}


def rare_word_index(templates: tuple[Template, ...], rare: int) -> dict[str, list[tuple[int, int]]]:
    """word -> (template number, place) under each template's `rare` words of highest IDF; ties by place."""
    weight, index = idf(templates), {}
    for t, template in enumerate(templates):
        w = template.words
        for j in sorted(range(len(w)), key=lambda j: (-weight[w[j]], j))[:rare]:
            index.setdefault(w[j], []).append((t, j))
    return index


def _strings(rows: list[list[str]]) -> Column:
    return F.array(*(F.array(*map(F.lit, r)) for r in rows))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, rare: int = 3, least_share: float = 0.6) -> DataFrame:
    """docs with _words and _found: (template, place, share of the IDF weight) of every verified alignment."""
    weight, index = idf(templates), rare_word_index(templates, rare)
    # An alignment is one number: the template, and its place moved up so that it isn't negative.
    entries = F.create_map(*(x for w, e in index.items() for x in (F.lit(w), F.array(*(F.lit(t * (1 << 40) - j + _SHIFT).cast("bigint") for t, j in e)))))
    words = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER), F.lit(_WORD), 1)
    proposed = F.transform("_words", lambda w, i: F.when(w.isin(list(index)), F.transform(F.element_at(entries, w), lambda e: e + i)))
    numbers = F.array_distinct(F.flatten(F.filter(proposed, lambda p: p.isNotNull())))

    # Constants by template: words, IDF shares, and the key phrase with its place.
    texts = _strings([t.words for t in templates])
    shares = F.array(*(F.array(*(F.lit(weight[w] / sum(weight[x] for x in t.words)) for w in t.words)) for t in templates))
    keys = _strings([t.key.split() for t in templates])
    key_at = F.array(*(F.lit(t.key_at) for t in templates))

    def verify(n: Column) -> Column:
        t, at = F.shiftright(n, 40).cast("int"), (n.bitwiseAND((1 << 40) - 1) - _SHIFT).cast("int")
        there = F.aggregate(
            F.transform(F.get(texts, t), lambda w, j: F.when(F.get("_words", at + j) == w, F.get(F.get(shares, t), j)).otherwise(0.0)),
            F.lit(0.0),
            lambda a, x: a + x,
        )
        key = F.forall(F.transform(F.get(keys, t), lambda w, j: F.coalesce(F.get("_words", at + F.get(key_at, t) + j) == w, F.lit(False))), lambda ok: ok)
        return F.struct(t.alias("template"), at.alias("place"), F.when(key, there).otherwise(0.0).alias("share"))

    found = F.filter(F.transform("_numbers", verify), lambda x: x["share"] >= least_share)
    return docs.withColumn("_words", words).withColumn("_numbers", numbers).withColumn("_found", found).drop("_numbers")


def _labels(found: Column, templates: tuple[Template, ...]) -> Column:
    names = F.array(*(F.lit(t.label) for t in templates))
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: F.get(names, x["template"])))), ",")


def license_labels(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    bases = [i for i, t in enumerate(templates) if t.base]
    found = scan(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), templates)
    base = found.withColumn("_base", F.filter("_found", lambda x: x["template"].isin(bases)))
    places = F.transform("_base", lambda x: x["place"])
    best = lambda c: F.coalesce(F.array_max(F.transform(c, lambda x: x["share"])), F.lit(0.0))
    other = F.filter("_found", lambda x: ~x["template"].isin(bases))
    return base.select(
        "doc_id",
        F.size("_words").cast("bigint").alias("n_words"),
        F.size("_base").cast("bigint").alias("n_base"),
        F.array_min(places).cast("bigint").alias("first_word"),
        F.array_max(places).cast("bigint").alias("last_word"),
        _labels(F.col("_base"), templates).alias("base_labels"),
        _labels(F.col("_found"), templates).alias("labels"),
        F.round(F.least(F.lit(1.0), F.greatest(best(other), 0.5 * best("_base"))), 9).alias("score"),
    )


def license_sql(templates: tuple[Template, ...] = TEMPLATES, rare: int = 3, least_share: float = 0.6) -> str:
    """The same rows by joins: every word against the index, alignments verified word by word. For tables with unique ids."""
    weight = idf(templates)
    texts = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    shares = lambda t: "[" + ", ".join(f"{weight[w] / sum(weight[x] for x in t.words)!r}::DOUBLE" for w in t.words) + "]"
    rows = ", ".join(f"({k}, '{t.label}', {texts(t.words)}, {texts(t.key.split())}, {t.key_at}, {str(t.base).lower()}, {shares(t)})" for k, t in enumerate(templates))
    index = ", ".join(f"('{w}', {k}, {j})" for w, entries in rare_word_index(templates, rare).items() for k, j in entries)
    return f"""WITH t AS (SELECT * FROM (VALUES {rows}) v(t, label, words, key_words, key_at, base, shares)),
r AS (SELECT * FROM (VALUES {index}) v(word, t, j)),
d AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD[1:-1]}') AS w FROM documents),
u AS (SELECT doc_id, UNNEST(w) AS word, UNNEST(range(len(w))) AS i FROM d),
a AS (SELECT DISTINCT doc_id, r.t, u.i - r.j AS p FROM u JOIN r USING (word)),
s AS (SELECT a.doc_id, a.p, t.label, t.base,
  list_sum(list_transform(range(1, len(t.words) + 1), lambda k: CASE WHEN a.p + k >= 1 AND d.w[a.p + k] = t.words[k] THEN t.shares[k] ELSE 0.0::DOUBLE END)) AS share,
  len(list_filter(range(1, len(t.key_words) + 1), lambda k: a.p + t.key_at + k >= 1 AND COALESCE(d.w[a.p + t.key_at + k] = t.key_words[k], false))) = len(t.key_words) AS is_keyed
  FROM a JOIN t ON t.t = a.t JOIN d ON d.doc_id = a.doc_id),
f AS (SELECT doc_id, COUNT(*) FILTER (WHERE base) AS n_base, MIN(p) FILTER (WHERE base) AS first_word, MAX(p) FILTER (WHERE base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
  MAX(CASE WHEN base THEN 0.5 * share ELSE share END) AS score FROM s WHERE is_keyed AND share >= {least_share} GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, COALESCE(n_base, 0) AS n_base, first_word, last_word, COALESCE(base_labels, '') AS base_labels, COALESCE(labels, '') AS labels,
  ROUND(LEAST(1.0::DOUBLE, COALESCE(score, 0)), 9) AS score FROM d LEFT JOIN f USING (doc_id)"""


def op5_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_labels(table(spark, sf_dir, "documents"))
