"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for all ten operators and stages."""

import hashlib
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from visitlens.llm import licenses, lines, media, packing, pieces, quality, repair, rules, simhash, toxicity
from visitlens.llm.common import stored, training_rows
from visitlens.llm.tokens import tokenizer_path

import corpus_pipeline

LONG = "long words and more of them " * 3000
PASSAGE = "\n".join(f"line {i} of a passage that is found in many documents of this table" for i in range(6))
ROWS = [
    (1, None), (2, ""), (3, "a"), (4, "Hello  world\n\nhello world\t"), (5, LONG), (6, "x" * 700), (7, "été ▁ 日本語 😀 \x0b \x1c    z"),
    (8, "All rights reserved. Licensed under CC BY-NC 4.0. all RIGHTS  reserved"), (9, "one two three four five six seven eight nine ten"),
    (10, "one two three four five six seven eight nine ten"), (10, "one two three four five six seven eight nine ten"), (None, "no id here"),
    (11, PASSAGE + "\nown words of eleven"), (12, "first\n" + PASSAGE), (13, "GNU General Public License, version 3"), (14, "   \n\t "), (15, "<|endoftext|> it's we'll"),
]
EXTRA = "stats long, score long, gone long, doc long, h long, kept_id long, copy long, fp long, ids long, part long, length long"


@pytest.fixture(scope="module")
def docs(spark):
    names = EXTRA.split(", ")
    return spark.createDataFrame([(*r, *range(len(names))) for r in ROWS], "doc_id long, text string, " + EXTRA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(1, 16)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def byte_ids(text, end):
    t = Tokenizer.from_file(tokenizer_path())
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def key(row):
    return (row.doc_id is None, row.doc_id or 0)


def test_token_ids_come_back(spark, docs, empty, tmp_path):
    repair.write_ids(docs, f"file://{tmp_path}/a", tokenizer_path(), block_ids=500)
    got = sorted(repair.id_digests(spark, f"file://{tmp_path}/a").collect(), key=lambda r: r.start)
    assert len(got) == len(ROWS)
    ids = [(i, byte_ids(t, 2)) for i, t in ROWS]
    assert sorted((r.n_tokens, r.ids_crc32) for r in got) == sorted((len(x), zlib.crc32(x.tobytes())) for _, x in ids)
    order = [r.doc_id for r in got]
    assert order[0] is None and order[1:] == sorted(order[1:])
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    assert {bytes(r.ids) for r in repair.read_ids(spark, f"file://{tmp_path}/a").collect()} == {x.tobytes() for _, x in ids}
    repair.write_ids(empty, f"file://{tmp_path}/b", tokenizer_path())
    assert repair.id_digests(spark, f"file://{tmp_path}/b").count() == 0


def test_grammar_round_trip():
    rng = np.random.default_rng(5)
    phrase = rng.integers(0, 300, 40)
    ids = np.concatenate([np.concatenate([phrase, rng.integers(0, 300, 20)]) for _ in range(200)] + [np.full(999, 7)]).astype(np.uint32)
    ends = np.sort(np.append(rng.choice(np.arange(1, len(ids)), 50, replace=False), [len(ids), len(ids)]))
    symbols, table, lengths, per_round, stops = repair.compress(ids, ends, 300, least=4)
    g = repair.Grammar(table, per_round, 300)
    assert (g.expand(symbols) == ids).all() and len(symbols) < len(ids) / 2 and stops[-1] == len(symbols)
    assert lengths.tolist() == g.count[300:].tolist()
    assert (repair.from_planes(repair.planes(symbols)) == symbols).all() and len(repair.from_planes(b"")) == 0
    for k in range(1, len(ends)):
        own, n = symbols[stops[k - 1] : stops[k]], ends[k] - ends[k - 1]
        assert (g.expand(own) == ids[ends[k - 1] : ends[k]]).all()
        for a, b in ((0, n), (n // 3, n), (0, n // 2), (n // 4, 3 * n // 4)):
            assert (repair.span_of(own, table, lengths, 300, a, b) == ids[ends[k - 1] + a : ends[k - 1] + b]).all()
    pairs = Counter()  # no frequent pair is left, counted plainly without overlaps
    for a, b in zip(np.append(0, stops[:-1]), stops):
        own, free = symbols[a:b].tolist(), {}
        for i, pair in enumerate(zip(own, own[1:])):
            if free.get(pair, -1) <= i:
                pairs[pair] += 1
                free[pair] = i + 2
    assert max(pairs.values()) < 4


def test_parts_of_a_written_table(spark, docs, tmp_path):
    path = f"file://{tmp_path}/ids"
    repair.write_ids(docs, path, tokenizer_path(), block_ids=300)
    whole = {}
    for r in repair.read_ids(spark, path).collect():
        whole.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4")))
    some = repair.read_documents(spark, path, [5, 10, 13, 999]).collect()
    assert sorted((r.doc_id, r.start, r.ids) for r in some) == sorted((i, s, x.tobytes()) for i in (5, 10, 13) for s, x in whole[i])
    every = np.concatenate([x for _, x in sorted((p for ps in whole.values() for p in ps), key=lambda p: p[0])])
    for a, b in ((0, 1), (17, 2000), (len(every) - 5, len(every) + 9), (3, 3)):
        parts = sorted(repair.read_span(spark, path, a, b).collect(), key=lambda r: r.start)
        got = np.concatenate([np.frombuffer(r.ids, "<u4") for r in parts]) if parts else every[:0]
        assert (got == every[a:b]).all() and all(r.start == a or r.start in {s for s, _ in whole[r.doc_id]} for r in parts)


def test_packing(docs, empty):
    got = packing.packed_digests(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, t in ROWS:
        x = byte_ids(t, 0)
        own = sorted(by[i], key=lambda r: r.start)
        times = sum(j == i for j, _ in ROWS)
        assert sum(r.length for r in own) == len(x) * times and all(r.doc_tokens == len(x) for r in own)
        assert all(zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and sum(n for _, n in p) <= 1024
    assert packing.packed_pieces(docs).where("octet_length(ids) != 4 * length").count() == 0
    assert packing.packed_digests(empty).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan_is_exact_and_tight(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 1025 if seed < 3 else 400, 2000)
    demand = Counter(sizes.tolist())
    used, cost = Counter(), 0
    for items, times in packing.packing_plan(dict(demand)):
        fill = sum(s * k for s, k in items.items())
        assert 0 < fill <= 1024 and times > 0
        cost += packing.padded(fill, 1024) * times
        for s, k in items.items():
            used[s] += k * times
    assert used == demand and cost <= 1.02 * sizes.sum()


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_near_duplicates(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    expected = [(i, brute_fingerprint(t)) for i, t in ROWS]
    assert sorted(((r.doc_id is None, r.doc_id), r.fp % (1 << 64)) for r in got) == sorted(((i is None, i), f) for i, f in expected)
    label = list(range(len(expected)))
    for _ in label:
        for a, (_, x) in enumerate(expected):
            for b, (_, y) in enumerate(expected):
                if (x ^ y).bit_count() <= 4:
                    label[a] = label[b] = min(label[a], label[b])
    for r in got:
        mine = {label[k] for k, (i, f) in enumerate(expected) if i == r.doc_id}.pop()
        ids = [i for k, (i, _) in enumerate(expected) if label[k] == mine and i is not None]
        assert r.component_id == (min(ids) if ids else None)
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {1, 9} <= set(ids) and not {2, 10, 14} & set(ids)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each_group(empty).count() == 0


def test_near_duplicates_broadcast_nothing(docs, monkeypatch):
    """What the driver holds must not grow with the fingerprints: no step's plan sends a table through it."""
    from visitlens.llm import components

    plans, plan_of = [], lambda df: df._jdf.queryExecution().executedPlan().toString()
    for module in (simhash, components):
        monkeypatch.setattr(module, "stored", lambda df, tag, codec="zstd": plans.append(plan_of(df)) or stored(df, tag, codec))
    plans += [plan_of(simhash.near_duplicates(docs)), plan_of(simhash.one_of_each_group(docs))]
    assert len(plans) > 8 and not [p for p in plans if "Broadcast" in p]


def test_crowded_buckets_lose_no_link(spark):
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 1 << 63))
    fps = sorted({base ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 5)), replace=False)) for _ in range(300)} | {int(x) for x in rng.integers(0, 1 << 63, 40)})
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    edges = {(r.u, r.v) for r in simhash.links(nodes, bucket=8).collect()}

    def groups(pairs):
        root = {f: f for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for u, v in pairs:
            root[find(u % (1 << 64))] = find(v % (1 << 64))
        out = {}
        for f in fps:
            out.setdefault(find(f), set()).add(f)
        return sorted(map(sorted, out.values()))

    assert groups(edges) == groups((a, b) for a in fps for b in fps if (a ^ b).bit_count() <= 4)


def test_media(docs, empty):
    got = media.probe_media(media.media_column(docs)).collect()
    assert len(got) == len(ROWS)
    want = Counter()
    for i, t in ROWS:
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64 if b else 64)
        want[i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    one = [tuple(r)[1:] for r in got if r.doc_id in (9, 10)]
    assert len({str(x) for x in one}) == 1 and all(len(r.tracks) == 1 and r.tracks[0].codec == "raw" and r.tracks[0].keyframes for r in got)
    stored = {r.doc_id: (r.media, r.n_bytes) for r in media.media_column(docs).collect()}
    for r in got:  # the ranges are those of the samples 1, 257, ... of the stored bytes
        m, n = stored[r.doc_id]
        at = m.index(b"mdat") + 4
        assert [(k.start, k.stop) for k in r.tracks[0].keyframes] == [(at + a, at + a + 64) for a in range(0, r.payload_bytes, 64 * 256)]
    assert media.probe(b"") == [] and media.probe(b"\x00\x00\x00\x10moovjunkjunk") == []
    assert media.probe_media(media.media_column(empty)).count() == 0


def test_media_tables_of_several_chunks():
    data = bytes(range(256)) * 300
    m = media.to_media(data)
    (t,) = media.probe(m)
    assert media.payload(m, t) == data and t["samples"] == len(data) // 64 and len(t["keyframes"]) == t["chunks"] == -(-t["samples"] // 256)
    assert all(m[a : a + n] == data[k * 16384 : k * 16384 + n] for k, (a, n) in enumerate(t["keyframes"]))
    for cut in range(0, len(m), 997):
        media.probe(m[:cut])


def test_pieces_round_trip(spark, docs, empty):
    import public_tokenizers

    v = pieces.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    shared = spark.sparkContext.broadcast(v)
    got = pieces.decode_documents(pieces.encode_documents(docs, shared), shared).collect()
    assert sorted((key(r), r.text) for r in got) == sorted(((i is None, i or 0), t or "") for i, t in ROWS)
    scores = dict(zip(v.ids.tolist(), v.scores.tolist(), strict=True))
    spelt = {int(i): t for i, t in zip(v.ids, v.texts, strict=True)}
    by_text = {t: s for t, s in zip(v.texts, v.scores, strict=True)}
    for r in got:
        text = b" " + r.text.encode() if r.text else b""
        if len(text) > 2000:
            continue
        best = [0.0] + [-np.inf] * len(text)
        for j in range(1, len(text) + 1):
            for i in range(max(0, j - v.longest), j):
                part = text[i:j]
                if part in by_text:
                    best[j] = max(best[j], best[i] + by_text[part])
            i = j - 1  # a character spelt in bytes: v.unknown, where it is no piece
            while i and 0x80 <= text[i] < 0xC0:
                i -= 1
            if text[i:j] not in by_text and (j == len(text) or not 0x80 <= text[j] < 0xC0):
                best[j] = max(best[j], best[i] + v.unknown)
        ids = np.frombuffer(r.ids, "<i4").tolist()
        spelling = b"".join(spelt[i] if i in spelt else bytes([v.byte_ids.tolist().index(i)]) for i in ids)
        assert spelling == text
        leads = sum(i not in spelt and not 0x80 <= v.byte_ids.tolist().index(i) < 0xC0 for i in ids)
        assert np.isclose(sum(scores.get(i, 0.0) for i in ids) + leads * v.unknown, best[-1])
    assert pieces.encode_documents(empty, shared).count() == 0


def test_double_array_holds_exactly_its_keys():
    keys = sorted({b"a", b"ab", b"abc", b"b", b"\xff\xfe", b" the", b" them", b"thou"})
    base, check, value = pieces.double_array(keys)

    def find(word):
        node = 0
        for c in word:
            to = int(base[node]) + c
            if check[to] != node or to == 0:
                return -1
            node = to
        return int(value[node])

    assert [find(k) for k in keys] == list(range(len(keys)))
    assert all(find(x) < 0 for x in (b"", b"c", b"abcd", b" th", b"\xff", b"them"))


def brute_statistics(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for x in (t or "").split("\n"):
        dup += x in seen and bool(re.search(r"[^\x20\x09-\x0D]", x))
        seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered)


def test_rule_statistics(docs, empty, labels):
    got = rules.with_statistics(docs.select("doc_id", "text")).select("doc_id", "stats.*").collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter((i, *brute_statistics(t)) for i, t in ROWS)
    by = {r.doc_id: r for r in got}
    assert by[4][6:-1] == (26, 20, 0, 1, 0, 3, 3, 5) and by[3][6:] == (1, 1, 0, 0, 0, 1, 1, 1, 0.0) and by[8].n_punctuation == 4 and by[8].n_digits == 2
    assert np.isclose(by[9].entropy, -sum(n / 48 * np.log2(n / 48) for n in Counter(dict(ROWS)[9]).values()))
    assert rules.passing_documents(docs, labels).columns == docs.columns
    assert rules.passing_documents(empty, labels).count() == 0
    assert rules.learn_rules(docs, labels.where("false")) == []


def test_decision_list_finds_thresholds(spark):
    rng = np.random.default_rng(0)
    x = np.c_[rng.integers(50, 900, 2000), rng.random((2000, 5))]
    good = ~((x[:, 2] > 0.7) | ((x[:, 5] > 0.5) & (x[:, 1] <= 0.4)))
    found = rules.decision_list(x, good)
    rejected = np.zeros(len(x), bool)
    for r in found:
        rejected |= r.covers(x)
    assert len(found) > 1 and (rejected == ~good).mean() > 0.97
    assert rules.decision_list(x[:0], good[:0]) == [] and rules.decision_list(x, np.ones(len(x), bool)) == []


def test_decision_list_needs_its_order():
    """Bad above a threshold, but for a corner of good rows in it: a rule with an exception before it."""
    rng = np.random.default_rng(4)
    x = rng.random((4000, 6))
    good = ~((x[:, 2] > 0.6) & ~((x[:, 3] <= 0.2) & (x[:, 2] > 0.6)))
    found = rules.decision_list(x, good)
    kept, open_ = np.ones(len(x), bool), np.ones(len(x), bool)
    for r in found:
        hit = open_ & r.covers(x)
        kept[hit], open_ = r.good, open_ & ~hit
    assert (kept == good).mean() > 0.98 and any(len(r.conditions) > 1 for r in found)


def test_verdict_equals_the_list(spark):
    rule = rules.Rule(((2, True, 0.25), (0, False, 80.0)), False)
    rows = [(60, 200, 30, 0, 0), (60, 200, 15, 0, 0), (90, 1, 90, 0, 0), (49, 0, 0, 0, 0), (100, 0, 0, 0, 51), (100, 0, 0, 0, 50)]
    df = spark.createDataFrame([(r,) for r in rows], "stats struct<n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long>")
    assert [r[0] for r in df.select(rules.verdict([rule])).collect()] == [False, True, True, False, False, True]


def brute_places(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(i, b.label) for b in licenses.BASE for i in range(len(w)) if w[i : i + len(b.words)] == b.words]
    return len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))


def test_licenses(docs, empty):
    got = licenses.license_labels(docs).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter((i, *brute_places(t)) for i, t in ROWS)
    by = {r.doc_id: r for r in got}
    assert by[8].labels == "cc-by,cc-by-nc,copyright,reserved" and by[13].labels == "gpl,gpl-3" and by[2].labels == "" and by[2].score == 0
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) <= set(r.labels.split(",")) for r in got)
    assert licenses.license_labels(empty).count() == 0


def test_license_index_proposes_every_template(spark):
    rows = [(k, f"before it {t.text} after it") for k, t in enumerate(licenses.TEMPLATES)]
    got = {r.doc_id: r for r in licenses.license_labels(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(t.label in got[k].labels.split(",") and got[k].n_words == len(t.words) + 4 for k, t in enumerate(licenses.TEMPLATES))


def brute_lines(rows, least):
    texts, seen, out = {}, {}, {}
    for k, t in rows:
        ls = t.split("\n")
        n = [len(x.encode().split()) for x in ls]
        gone = [False] * len(ls)
        for a in range(len(ls)):
            for j, p in seen.get(ls[a], []):
                m = 0
                while a + m < len(ls) and p + m < len(texts[j]) and texts[j][p + m] == ls[a + m]:
                    m += 1
                if sum(n[a : a + m]) >= least:
                    gone[a : a + m] = [True] * m
            texts[k] = ls
            seen.setdefault(ls[a], []).append((k, a))
        out[k] = "\n".join(x for x, g in zip(ls, gone) if not g)
    return out


def test_repeated_lines(spark, docs, empty):
    got = lines.without_repeated_lines(docs)
    assert got.columns == docs.columns and got.count() == len(ROWS)
    by = {r.doc_id: r.text for r in got.collect()}
    assert by[1] is None and by[2] == "" and by[11] == PASSAGE + "\nown words of eleven" and by[12] == "first" and by[10] == dict(ROWS)[10]
    assert lines.without_repeated_lines(empty).count() == 0
    rng = np.random.default_rng(8)
    some = [(i, "\n".join(" ".join(["w"] * (x % 3) + [f"l{x}"]) for x in rng.integers(0, 5, int(rng.integers(1, 30))))) for i in range(30)]
    table = spark.createDataFrame([(i, t, 0) for i, t in some], "doc_id long, text string, n_chars long")
    for least in (1, 4, 9):
        found = {r.doc_id: r for r in lines.without_repeated_lines(table, least).collect()}
        want = brute_lines(some, least)
        assert {i: r.text for i, r in found.items()} == want
        assert all(r.n_chars in (0, len(r.text)) for r in found.values())


def test_suffix_array_is_in_order(spark):
    """Ranks of suffixes by their first 4 lines, against sorting them plainly; equal prefixes share a rank."""
    rng = np.random.default_rng(6)
    some = [(i, "\n".join(f"w {x}" for x in rng.integers(0, 4, int(rng.integers(2, 12))))) for i in range(12)]
    table = spark.createDataFrame(some, "doc_id long, text string")
    found = lines.suffix_array(table, 4, least_words=2).collect()
    first = {r.line_text: r.rank for r in lines.suffix_array(table, 1, 2).join(table, F.col("doc") == F.col("doc_id")).select("rank", F.get(F.split("text", "\n"), F.col("line")).alias("line_text")).collect()}
    texts = {i: t.split("\n") for i, t in some}
    key = lambda r: [first[x] for x in texts[r.doc][r.line : r.line + 4]]
    assert len(found) == sum(map(len, texts.values()))
    assert [key(r) for r in found] == sorted(key(r) for r in found)
    assert all((a.rank == b.rank) == (key(a) == key(b)) for a, b in zip(found, found[1:]))


def test_toxicity_small(docs, empty, labels):
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (9, 10)}) == 1 and len({r.score for r in got if r.doc_id in (1, 2, 14)}) == 1
    assert toxicity.toxicity(empty, labels).count() == 0
    assert all(r.score == 0.5 for r in toxicity.toxicity(docs, labels.where("false")).collect())


def brute_models(rows, order, discount=0.75):
    """log ratios by class-conditional Kneser-Ney with dictionaries; rows: (text, y)."""
    stream = lambda t: re.sub(rb"[\x00-\x60\x7b-\x7f]+", b" ", (t or "").lower().encode())
    grams_in = lambda t: [(b" " * (order - 1) + stream(t))[i : i + order] for i in range(len(stream(t)))]
    by_class = [Counter(g for t, y in rows if y == c for g in grams_in(t)) for c in (1, 0)]
    shorter = {order: set(by_class[0]) | set(by_class[1])}
    before = {}
    for k in range(order - 1, 0, -1):
        before[k] = Counter(g[1:] for g in shorter[k + 1])
        shorter[k] = set(before[k])

    def shared(g):
        if not g:
            return 1 / 256
        own = {x: n for x, n in before[len(g)].items() if x[:-1] == g[:-1]}
        if not own:
            return shared(g[1:])
        return max(own.get(g, 0) - discount, 0) / sum(own.values()) + discount * len(own) / sum(own.values()) * shared(g[1:])

    def p(g, counts):
        own = {x: n for x, n in counts.items() if x[:-1] == g[:-1]}
        if not own:
            return shared(g[1:])
        return max(own.get(g, 0) - discount, 0) / sum(own.values()) + discount * len(own) / sum(own.values()) * shared(g[1:])

    return grams_in, (lambda g: np.log(p(g, by_class[0])) - np.log(p(g, by_class[1]))), p, by_class


RUDE = [("you Rude fool, you rude fool!", 1), ("a kind word for you", 0), ("rude rude words; fool", 1), ("the kind fox, 3 words", 0), ("été kind", 0), (None, 0)]


def test_ratios_equal_those_of_dictionaries(spark):
    order = 4
    rows = spark.createDataFrame(RUDE, "text string, y int").select(F.coalesce("text", F.lit("")).alias("text"), "y").repartition(3)
    got = toxicity.count_grams(rows, order).toArrow()
    models = toxicity.kneser_ney(got["gram"].to_numpy().view(np.uint64), got["toxic"].to_numpy(), got["ordinary"].to_numpy(), order)
    grams_in, ratio, p, counts = brute_models(RUDE, order)
    assert sum(c.total() for c in counts) == sum(got["toxic"].to_pylist()) + sum(got["ordinary"].to_pylist())
    for history in (b"rud", b"kin", b" yo"):  # each model's probabilities sum to one
        assert all(np.isclose(sum(p(history + bytes([b]), c) for b in range(256)), 1) for c in counts)
    texts = ["rude fool", "a kind fool!!", "zebra", "", "kind words, rude words", "été été"]
    flat = "".join(texts).lower().encode()
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    found = toxicity.ratio_features(models, np.frombuffer(flat, np.uint8), offsets, (3, 6))
    for t, row in zip(texts, found):
        r = [ratio(g) if any(g[:-1] == x[:-1] for c in counts for x in c) else 0.0 for g in grams_in(t)]
        best = lambda w: max(np.mean(r[i : i + w]) for i in range(max(1, len(r) - w + 1)))  # noqa: B023,E731
        assert np.allclose(row, [np.mean(r), best(3), best(6)] if r else 0)


def test_a_lower_order_counts_the_same_bytes(spark):
    rows = spark.createDataFrame(RUDE[:-1], "text string, y int")
    five, four = (toxicity.count_grams(rows, k).toPandas().set_index("gram").sort_index() for k in (5, 4))
    models = toxicity.models_of(stored(toxicity.count_grams(rows, 5), "grams"), 5, len(five) - 1)
    assert models.order == 4 and (models.grams == four.index.to_numpy().view(np.uint64)).all()
    assert five.sum().tolist() == four.sum().tolist()


def test_the_order_never_depends_on_the_tables():
    """The alphabet bounds the n-grams, so nothing has to be switched when tables grow."""
    import inspect

    text = np.unique(np.frombuffer(bytes(range(256)).lower(), np.uint8))
    signs = np.unique(toxicity.running_text(text, np.array([0, len(text)]))[0])
    assert len(signs) == 155 and len(signs) ** toxicity.ORDER < 1 << 22
    assert "most_grams" not in inspect.signature(toxicity.learn).parameters


def test_learning_is_bounded_and_the_same_on_any_partitions(spark, docs, labels):
    many = spark.createDataFrame([(7, f"text {k % 3}") for k in range(500)], "doc_id long, text string")
    rows = training_rows(many, spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, toxic int"), "toxic", 10).collect()
    assert [(r.doc_id, r.y, r.text) for r in rows] == [(7, 1, "text 0")]
    a, b = (toxicity.toxicity(docs.repartition(n), labels).collect() for n in (1, 5))
    assert Counter(map(str, a)) == Counter(map(str, b))
    (w, bias, _), (w2, bias2, _) = (quality.train(docs.repartition(n), labels, least=1) for n in (1, 5))
    assert (w == w2).all() and bias == bias2 and w.any()
    assert rules.learn_rules(docs.repartition(1), labels) == rules.learn_rules(docs.repartition(5), labels)


def test_quality_small(docs, empty, labels):
    model = quality.train(docs, labels)
    got = quality.with_quality(docs, model)
    assert got.columns == [*docs.columns, "score_"] and got.count() == len(ROWS)
    assert all(0 <= r.score_ <= 1 for r in got.collect())
    assert quality.good_documents(docs, labels).columns == docs.columns
    assert quality.good_documents(empty, labels).count() == 0
    same = {r.score_ for r in quality.with_quality(docs, quality.train(docs, labels.where("false"))).collect()}
    assert len(same) == 1


def test_margins_are_sums_of_ratio_times_weight(spark, docs, labels):
    """Dense vectors over the n-grams that each text has give the scores that the sparse ones give."""
    w, bias, (shape, line) = quality.train(docs, labels, least=1)
    lists = {(r.doc_id, tuple(r.grams)) for r in quality.gram_lists(docs.where("doc_id is not null"), "doc_id").collect()}
    scores = {r.doc_id: r.score_ for r in quality.with_quality(docs, (w, bias, (shape, line))).collect()}
    for i, grams in lists:
        dense = np.zeros(1 << quality.BITS)
        dense[list(grams)] = 1
        margin = np.arcsinh(dense @ w.astype(np.float32).astype(float) + bias)
        assert np.isclose(scores[i], 1 / (1 + np.exp(-np.clip((margin - shape[0][0]) / shape[1][0] * line[0] + line[1], -30, 30))))


def test_dual_coordinate_descent_meets_the_optimum():
    rng = np.random.default_rng(2)
    x = (rng.random((80, 12)) < 0.4).astype(float)
    y = np.where(x[:, 0] + x[:, 1] - x[:, 2] + rng.normal(0, 0.3, 80) > 0.6, 1, -1)
    flat, ends = np.concatenate([np.flatnonzero(r) for r in x]), np.cumsum(x.sum(1)).astype(int)
    value, cost = rng.normal(1, 0.3, 12), np.full(80, 0.5)
    w, b = quality.dual_coordinate_descent(flat, ends, value, y, cost, epochs=3000, tolerance=1e-6)
    z = x * value
    loss = lambda w, b: 0.5 * (w @ w + b * b) + (cost * np.maximum(0, 1 - y * (z @ w + b))).sum()
    best = loss(w, b)
    assert all(loss(w + rng.normal(0, s, 12), b + rng.normal(0, s)) >= best - 1e-2 for s in (0.01, 0.1) for _ in range(50))


def test_stages_run_on_small_and_empty_tables(spark, docs, empty, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for start in (docs, empty):
        df, n = start, start.count()
        for name, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, str(tmp_path))
            rows = df.count()
            assert name == "packing" or (df.columns == docs.columns and rows <= n)
            n = rows


def box(kind, *body):
    data = b"".join(body)
    return struct.pack(">I4s", len(data) + 8, kind) + data


def track_boxes(number, scale, samples, sizes, offsets, stss=None, wide=False):
    full = lambda kind, *body: box(kind, bytes(4), *body)
    u32 = lambda *x: struct.pack(f">{len(x)}I", *x)
    stbl = box(
        b"stbl", full(b"stsd", u32(1), box(b"mp4a", bytes(28))), full(b"stsc", u32(1, 1, 1, 1) if samples else u32(0)), full(b"stsz", u32(0, samples, *sizes)),
        full(b"co64", u32(samples), struct.pack(f">{samples}Q", *offsets)) if wide else full(b"stco", u32(samples, *offsets)), *([full(b"stss", u32(len(stss), *stss))] if stss else []),
    )
    return box(b"trak", full(b"tkhd", u32(0, 0, number)), box(b"mdia", full(b"mdhd", u32(0, 0, scale, 10 * samples, 0)), box(b"minf", stbl)))


def test_tracks_fragments_and_wide_offsets():
    u32 = lambda *x: struct.pack(f">{len(x)}I", *x)
    trex = box(b"trex", bytes(4), u32(2, 1, 10, 3, 0x10000))
    trun = lambda offset, sizes: box(b"trun", u32(0x205, len(sizes), offset, 0, *sizes))
    traf = lambda offset: box(b"traf", box(b"tfhd", u32(0x20000, 2)), trun(offset, [3, 4]), box(b"trun", u32(0, 2)))
    moov = lambda a: box(b"moov", track_boxes(1, 100, 3, [2, 3, 4], [a, a + 2, a + 5], wide=True), track_boxes(2, 50, 0, [], []), box(b"mvex", trex))
    data = bytes(range(100, 122))
    media_at = len(moov(0)) + 8
    head = moov(media_at) + box(b"mdat", data[:9])
    moof = lambda offset: box(b"moof", traf(offset))
    m = head + moof(len(moof(0)) + 8) + box(b"mdat", data[9:])
    one, two = media.probe(m)
    assert media.payload(m, one) == data[:9] and len(one["keyframes"]) == 3 and one["duration"] == 30
    assert media.payload(m, two) == data[9:22] and two["samples"] == 4 and two["duration"] == 40
    assert [m[a : a + n] for a, n in two["keyframes"].tolist()] == [data[9:12]]  # the first by its own flags; the rest are no keyframes by default
    for cut in range(len(m)):
        media.probe(m[:cut])
    assert len(media.probe(head + box(b"moof", box(b"traf", box(b"tfhd", u32(0, 2)), box(b"trun", u32(0x200, 9)))))) == 1  # track 2's run breaks off


def least_padded(left, capacity, known):
    """The least sum of padded lengths, by trying all fillings that hold the longest item left."""
    key = tuple(sorted(left.items()))
    if not any(left.values()):
        return 0
    if key not in known:
        longest = max(s for s in left if left[s])
        best, todo = 10**9, [({longest: 1}, longest)]
        seen = set()
        while todo:
            items, fill = todo.pop()
            mark = tuple(sorted(items.items()))
            if mark in seen:
                continue
            seen.add(mark)
            rest = {s: n - items.get(s, 0) for s, n in left.items()}
            best = min(best, packing.padded(fill, capacity) + least_padded(rest, capacity, known))
            todo += [(items | {s: items.get(s, 0) + 1}, fill + s) for s in left if rest[s] and fill + s <= capacity]
        known[key] = best
    return known[key]


@pytest.mark.parametrize("demand", [{3: 4, 5: 3, 7: 2}, {6: 5, 5: 4}, {2: 3, 9: 2, 4: 4}, {8: 3, 7: 2, 1: 2}])
def test_packing_costs_little_more_than_the_least(demand):
    capacity = 16
    least = least_padded(demand, capacity, {})
    cost = sum(packing.padded(sum(s * k for s, k in items.items()), capacity) * n for items, n in packing.packing_plan(dict(demand), capacity))
    bound = sum(packing.padded(sum(s * k for s, k in p.items()), capacity) * n for p, n in packing.fractional_patterns(dict(demand), capacity))
    assert least <= cost <= least + capacity and bound <= least * 1.001


def test_grammars_hold_where_frequent_pairs_share_a_slot(monkeypatch):
    import numpy as np

    from visitlens.llm import repair

    g = np.random.default_rng(3)
    for bits in (1, 4, 17):
        monkeypatch.setattr(repair, "_RANK_BITS", bits)
        ids, ends = g.zipf(1.4, 4000).clip(0, 40).astype(np.uint32), np.array([0, 7, 7, 2500, 4000])
        symbols, rules, lengths, rounds, stops = repair.compress(ids, ends, 41, least=4)
        grammar = repair.Grammar(rules, rounds, 41)
        assert len(rules) and np.array_equal(grammar.expand(symbols), ids)
        assert [len(grammar.expand(symbols[:x])) for x in stops] == ends.tolist()
        last = np.zeros(len(symbols), bool)
        last[stops[stops > 0] - 1] = True
        assert not len(repair._frequent((k := repair._pairs(symbols.astype(np.uint64), last, np.arange(len(symbols) - 1)))[k != repair._NONE], 4))


def test_all_frequent_pairs_are_replaced_in_one_round(monkeypatch):
    import numpy as np

    from visitlens.llm import repair

    n = 20_000  # pairs of four places each, in documents of one pair; some would share a slot of a hash table
    ids = np.random.default_rng(7).permuted(np.tile(np.arange(n), 4)).repeat(2) * 2 + np.tile([0, 1], 4 * n)
    ends = np.arange(2, len(ids) + 1, 2)
    symbols, rules, lengths, rounds, stops = repair.compress(ids.astype(np.uint32), ends, 2 * n, least=4)
    assert rounds == [n] and len(symbols) == 4 * n and (lengths == 2).all()
    assert sorted(rules.tolist()) == [[2 * k, 2 * k + 1] for k in range(n)]
    # A pair and its place in one number or in two: the same grammar.
    g = np.random.default_rng(8)
    ids, ends = g.zipf(1.3, 30_000).clip(0, 60).astype(np.uint32), np.array([0, 1, 1, 900, 901, 30_000])
    whole = repair.compress(ids, ends, 61, least=4)
    monkeypatch.setattr(repair, "_RANK_BITS", 3)
    for a, b in zip(whole, repair.compress(ids, ends, 61, least=4), strict=True):
        assert np.array_equal(a, b)
    for size in (0, 1, 2):
        symbols, rules, _, rounds, stops = repair.compress(ids[:size], np.array([0, size]), 61)
        assert symbols.tolist() == ids[:size].tolist() and len(rules) == 0 and rounds == [] and stops.tolist() == [0, size]


def test_words_met_again_stay_when_the_cache_is_full():
    import numpy as np

    from visitlens.llm.wordhash import WordCache

    computed = Counter()

    def compute(raw, starts, lengths):
        words = [raw[a : a + n].tobytes() for a, n in zip(starts, lengths, strict=True)]
        computed.update(words)
        return np.array([int(w) for w in words for _ in range(int(w) % 3)], np.int64), np.array([int(w) % 3 for w in words])

    def look(cache, numbers):
        words = [b"%d" % k for k in numbers]
        lengths = np.array([len(w) for w in words])
        row = cache.rows(np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths, lengths)
        for k, r in zip(numbers, row, strict=True):
            assert cache.pool[cache.offset[r] : cache.offset[r] + cache.count[r]].tolist() == [k] * (k % 3)
        assert cache.table.rows <= cache.table.capacity

    cache = WordCache(compute, np.int64, capacity=100, pool=10_000)
    for k in range(40):  # ten words that come again and again, thirty that don't
        look(cache, [*range(10), *range(1000 + 30 * k, 1030 + 30 * k)])
    assert all(computed[b"%d" % k] == 1 for k in range(10)) and max(computed.values()) == 1
    for pool in (10_000, 60):  # all come again: half of them stay at most, by number and by length
        computed.clear()
        cache = WordCache(compute, np.int64, capacity=100, pool=pool)
        for numbers in (range(90), range(90), range(90, 120), range(90), range(300), range(5)):
            look(cache, list(numbers))
    assert computed[b"89"] > 1
