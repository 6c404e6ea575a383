"""The registered text queries over whole tables: held-out accuracy, SQL where there is some, brute force for the rest."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from test_small_cases import brute_fingerprint, brute_statistics, byte_ids

from visitlens.llm.queries import ORACLE_SQL, QUERIES

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}


def run(spark, n, sf_dir=SMALL):
    name = next(x for x in QUERIES if x.startswith(f"op{n}_"))
    return QUERIES[name](spark, sf_dir)


@pytest.mark.parametrize(("n", "label", "least"), [(1, "toxic", 0.9), (4, "quality", 0.95)])
def test_held_out_accuracy(spark, n, label, least):
    got = {r.doc_id: r for r in run(spark, n, LARGER).collect()}
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert len(held) > 50 and sum(got[i].predicted == truth[i] for i in held) / len(held) >= least
    assert all(r.predicted == (r.score >= (0.5 if n == 1 else 0.3)) for r in got.values())
    for value in (0, 1):  # both classes are found, not the larger one alone
        own = [i for i in held if truth[i] == value]
        assert sum(got[i].predicted == value for i in own) / len(own) >= 0.6


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_equal_sql(spark, name):
    con = duckdb.connect()
    for name_ in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {name_} AS SELECT * FROM '{LARGER}/{name_}.parquet'")
    want = con.execute(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, LARGER).toPandas()[list(want.columns)]
    text = lambda df: sorted(tuple("null" if pd.isna(x) else f"{x:.9g}" if isinstance(x, (int, float, np.number)) else x for x in r) for r in df.itertuples(index=False, name=None))
    assert text(got) == text(want)


def test_rules_keep_base(spark, texts):
    got = run(spark, 3).collect()
    assert {r.doc_id: tuple(r)[1:6] for r in got} == {i: brute_statistics(t) for i, t in texts.items()}
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in got)


def test_token_ids(spark, texts):
    start = 0
    got = {r.doc_id: r for r in run(spark, 6).collect()}
    for i in sorted(texts):
        ids = byte_ids(texts[i], 2)
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_fingerprints_and_components(spark, texts):
    got = {r.doc_id: r for r in run(spark, 8).collect()}
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in prints.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if b > a and (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {i: r.component_id for i, r in got.items()} == {i: find(i) for i in texts}


def test_media(spark, texts):
    for r in run(spark, 9).collect():
        b = texts[r.doc_id].encode()
        p = b + bytes(-len(b) % 64 if b else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))


def test_packing(spark, texts):
    got = run(spark, 10).collect()
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    total = 0
    for i, t in texts.items():
        ids, at = byte_ids(t, 0), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
        total += at
    stored = 0
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        fill = sum(r.length for r in own)
        assert [r.offset for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]] and fill <= 1024
        stored += fill if fill & (fill - 1) == 0 else 1024
    assert stored <= 1.1 * total


def test_every_text_comes_back_from_pieces(spark, texts):
    got = run(spark, 2).collect()
    assert len(got) == len(texts) and all(r.same_text and r.decoded_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got)
    assert not Counter(r.n_pieces > 0 for r in got if texts[r.doc_id])[False]
