"""Hard negatives, byte-level BPE by recursive queries and spelling variants, against brute force and the library."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

from pyspark.sql import functions as F

from visitlens.llm import duckbpe, negatives, spelling
from visitlens.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


# Hard negatives


def brute_negatives(rows, every=50):
    usable = {(i, (y + 1) % 10 if i % 7 == 0 else y, tuple(np.floor(256 * np.array(v, float)).astype(int).tolist())) for i, y, v in rows if None not in (i, y, v) and None not in v and np.isfinite(np.array(v, float)).all()}
    product = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, y, v in sorted(usable):
        if i % every:
            continue
        scored = sorted((-product(v, w), j, z) for j, z, w in usable if j != i)
        for s, j, _ in [x for x in scored if x[2] == y][:5]:
            hard = [(-t, k) for t, k, z in scored if z != y and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(i, j, r + 1, k, -s, t) for r, (t, k) in enumerate(hard)]
    return sorted(out)


def vectors(spark, tmp_path, rows, kind="float"):
    path = f"{tmp_path}/{random.random()}"
    spark.createDataFrame([(*r, 0) for r in rows], f"vec_id long, embedding array<{kind}>, label int, v int").select("vec_id", "embedding", "label", "v", F.lit(1).alias("block"), F.lit(2).alias("score")).repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return path


def negatives_of(spark, path):
    return sorted(map(tuple, negatives.op11_hard_negatives(spark, path).collect()))


def test_hard_negatives_small_cases(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, [r.choice([-0.5, 0.25, 0.5, 1.0]) for _ in range(4)], i % 3) for i in range(160)]  # many ties
    rows += rows[40:60] * 3  # repeated rows
    rows += [(None, [1.0] * 4, 1), (200, None, 1), (250, [1.0, None, 1.0, 1.0], 1), (300, [1.0, float("nan"), 0.0, 0.0], 1), (350, [float("inf")] * 4, 2), (400, [1.0] * 4, None), (450, [], 1), (500, [1.0, 2.0], 0), (550, [0.0] * 4, 1)]
    got = negatives_of(spark, vectors(spark, tmp_path, rows))
    pad = lambda v: v and v + [0.0] * (4 - len(v)) if v is not None and len(v) else v if v is None else [0.0] * 4
    assert got == brute_negatives([(i, y, pad(v)) for i, v, y in rows]) and len(got) > 20
    assert negatives_of(spark, vectors(spark, tmp_path, [])) == []
    assert negatives_of(spark, vectors(spark, tmp_path, [(0, [1.0], 1)])) == []


def test_hard_negatives_of_large_numbers(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, [float(r.randint(-(2**21), 2**21)) for _ in range(3)], i % 2) for i in range(120)]  # scores beyond 2 ** 53
    assert negatives_of(spark, vectors(spark, tmp_path, rows, "double")) == brute_negatives([(i, y, v) for i, v, y in rows])


def test_bounds_save_scores_and_change_nothing(spark):
    r = np.random.default_rng(5)
    centres = r.integers(-200, 200, (12, 16))
    v = (centres[r.integers(0, 12, 3000)] + r.integers(-9, 10, (3000, 16))).astype(np.int64)
    ids, labels = np.arange(3000), r.integers(0, 4, 3000)
    rows = spark.createDataFrame([(int(i), int(y), x.tolist()) for i, y, x in zip(ids, labels, v)], "vec_id long, label long, v array<bigint>").repartition(4)
    chosen = rows.where("vec_id % 20 = 0")
    got = {b: sorted(map(tuple, negatives.hard_negatives(rows, chosen, block=b, most_anchors=m).collect())) for b, m in ((256, 1 << 14), (16, 40), (1, 1 << 14))}
    want = []
    for a in range(0, 3000, 20):
        s = v @ v[a]
        near = [i for i in np.lexsort([ids, -s]) if labels[i] == labels[a] and i != a][:5]
        for p in near:
            hard = [i for i in np.lexsort([ids, -s]) if labels[i] != labels[a] and 50 * s[p] <= 100 * s[i] <= 95 * s[p]][:3]
            want += [(a, p, k + 1, i, s[p], s[i]) for k, i in enumerate(hard)]
    assert all(g == sorted(want) for g in got.values())
    trees = negatives.anchor_trees(chosen).orderBy("block", "pos").toArrow()
    anchors = negatives.Anchors.of(trees)
    scored = negatives.search(negatives.Best(anchors.windows, 5), anchors, ids, labels, v, True)
    assert scored < 0.3 * len(ids) * 150


def test_spanning_tree_is_least():
    v = np.random.default_rng(6).integers(0, 50, (40, 3))
    order, parent, length = negatives.spanning_tree(v)
    d = np.sqrt(((v[:, None].astype(float) - v[None]) ** 2).sum(2))
    assert sorted(order) == list(range(40)) and all(np.isclose(length[i], d[i, parent[i]]) for i in order[1:])
    edges, root = sorted((d[i, j], i, j) for i in range(40) for j in range(i)), list(range(40))
    total = 0.0
    for w, i, j in edges:  # the least weight, by joining nearest parts
        if root[i] != root[j]:
            total, gone = total + w, root[i]
            root = [root[j] if x == gone else x for x in root]
    assert np.isclose(length.sum(), total)


# Byte-level BPE


@pytest.fixture(scope="module")
def bpe():
    return duckbpe.DuckBpe(duckbpe.rank_path())


@pytest.fixture(scope="module")
def library(bpe):
    import public_tokenizers

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def ids_by_text(bpe, texts):
    out = []
    for _, ids, counts in bpe.batches(pa.array(texts, pa.string())):
        ends = np.cumsum(counts)
        assert [b"".join(p).decode() for p in bpe.decode(ids, counts)] == [t or "" for t in texts[len(out) : len(out) + len(counts)]]
        out += [ids[e - n : e].tolist() for e, n in zip(ends, counts)]
    return out


def test_ids_are_the_librarys(bpe, library):
    r = random.Random(1)
    signs = ["'", "s", "t", "re", "ve", "ll", "m", "d", " ", "  ", "\n", "\t", "a", "Ab", "é", "日本", "1", "²", "٣", "!", "--", "　", "\xa0", "́", "😀", "\x1c", "\x85", "'S", "<|endoftext|>"]
    texts = ["".join(r.choices(signs, k=r.randint(0, 30))) for _ in range(4000)] + [None, ""]
    assert ids_by_text(bpe, texts) == [library.encode_ordinary(t or "") for t in texts]


def test_long_words(bpe, library):
    r = random.Random(2)
    texts = ["a" * 3000, "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=8000)), "".join(r.choices("ACGT", k=2000)), "ab" * 900 + "aab" * 500, "日本語の" * 300, "!?" * 900, "".join(r.choices("01", k=1500)), " " * 2000, "\n" * 999 + "a"]
    assert ids_by_text(bpe, texts) == [library.encode_ordinary(t) for t in texts]


def test_both_queries_contract_alike(bpe):
    r = random.Random(7)
    words = ["".join(r.choices("aeinst", k=r.randint(2, 40))).encode() for _ in range(500)]
    assert all((a == b).all() for a, b in zip(bpe.contracted(words), bpe.contracted(words, duckbpe._ALL_NEXT), strict=True))


def test_decoding_in_parts(bpe, monkeypatch):
    monkeypatch.setattr(duckbpe, "PART", 3)
    texts = ["one two three four five six", "", "seven", None]
    ids_by_text(bpe, texts)


def test_character_classes_are_the_librarys(bpe):
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    spelling_ = tiktoken.Encoding("bytes", pat_str=r"\s", mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    assert {ord(c) for c in bytes(spelling_.encode_ordinary(every)).decode()} == set(duckbpe.WHITE)


def test_bpe_query(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in QUERIES["op12_duckdb_bpe"](spark, SMALL).collect()}
    assert len(got) == len(texts)
    for i, t in texts.items():
        ids = np.array(library.encode_ordinary(t or ""), "<u4")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_bpe_small_cases(spark, library):
    rows = [(1, None), (None, "no id"), (2, ""), (3, "same"), (3, "same"), (4, "very long text 日本 " * 20_000)]
    docs = spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id long, text string, ids int, n_tokens int").repartition(2)
    path = duckbpe.rank_path()
    got = duckbpe.encoded(docs, path)
    assert sorted(((r.doc_id, r.ids) for r in got.collect()), key=str) == sorted(((i, library.encode_ordinary(t or "")) for i, t in rows), key=str)
    assert sorted(((r.doc_id, bytes(r.bytes).decode()) for r in duckbpe.decoded(got, path).collect()), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert duckbpe.digests(docs, path).count() == len(rows) and duckbpe.digests(docs.where("false"), path).count() == 0
    odd = spark.sql("SELECT 1 AS doc_id, unhex('61FF62') AS text")
    assert duckbpe.encoded(odd, path).first().ids == library.encode_ordinary("a�b")


# Spelling variants


def brute_variants(rows, slips=199):
    counts = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.encode().lower().decode()
            h = zlib.crc32(f"{'null' if i is None else i}:{w}".encode())
            if slips and h % slips == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    masks, near = defaultdict(set), {w: set() for w in n}
    for w in n:
        for k in range(len(w)):
            masks[k, w[:k] + "?" + w[k + 1 :]].add(w)
            if (v := w[:k] + w[k + 1 :]) in n:
                near[w].add(v)
                near[v].add(w)
    for group in masks.values():
        for w in group:
            near[w] |= group - {w}
    best = {w: min(near[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: b if b and n[b] >= 5 * n[w] else None for w, b in best.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted(((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n), key=str)


def variants(spark, docs, **how):
    got = spelling.spelling_variants(docs, **how)
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got.collect()), key=str)


@pytest.mark.parametrize("sf_dir", [SMALL, "/root/testdata/sf0.01"])
def test_variants_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op13_spelling_variants"](spark, sf_dir).collect()
    assert sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got), key=str) == brute_variants(rows)


def test_variants_of_few_letters(spark):
    """Words of few letters are near many others, share halves, and make chains; tiles of few words split each group."""
    r = random.Random(8)
    words = ["".join(r.choices("abé", k=r.choice([6, 7, 8, 9]))) for _ in range(900)]
    texts = [" ".join([w] * r.choice([1, 5, 6, 30, 160, 900])) for w in words]
    rows = [(i, t.upper() if i % 9 == 0 else t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_variants(rows)
    assert sum(w[1] is not None for w in want) > 100 and any(w[1] != w[2] for w in want if w[1])
    for tile in (512, 7):
        assert variants(spark, docs, slips=199, tile=tile) == want
    assert variants(spark, docs) == brute_variants(rows, None)


def test_variants_small_cases(spark):
    long = "x" * 5000
    rows = [(1, None), (2, ""), (None, "letters " * 6), (3, "leters " * 30), (3, "leters " * 30), (4, (long + " ") * 6 + (long[:-1] + "y ") * 40), (5, "×÷×÷×÷ " * 5 + "Ünicöde ünicöde " * 3), (6, "12345678 _____ ------")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, word int, n int").repartition(2)
    assert variants(spark, docs, slips=199) == brute_variants(rows)
    assert variants(spark, docs.where("false"), slips=199) == []


def test_crc32_of_spans():
    words = [b"", b"a", b"hello", b"x" * 300]
    raw = np.frombuffer(b"".join(words), np.uint8)
    n = np.array([len(w) for w in words])
    before = np.array([zlib.crc32(b"17:")] * 4, np.uint32)
    assert spelling.crc32_of(raw, np.cumsum(n) - n, n, before).tolist() == [zlib.crc32(b"17:" + w) for w in words]
