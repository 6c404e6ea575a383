"""Rows that earlier forms of the text operators left out or read differently."""

import zlib

import numpy as np
from tokenizers import Tokenizer

from visitlens.llm import packing, repair, simhash
from visitlens.llm.tokens import tokenizer_path

WORDS = "alder birch cedar dogwood elm fir gum hazel ivy juniper kapok larch maple nutmeg oak pine quince rowan spruce teak".split()


def own(i):
    """A text that is no near copy of own(j)."""
    return " ".join(f"{w}{i * 31 + n}" for n, w in enumerate(WORDS))


def test_one_row_of_every_component(spark):
    one = own(1)
    near = one.replace("  ", " ") + " "  # equal words: fingerprint of `one`, another text
    rows = [
        (None, own(10)), (None, own(11)), (None, own(12)), (None, own(12)),  # null ids: three different texts
        (5, own(20)), (5, own(21)),  # one id, two texts
        (1, one), (7, near), (7, own(30)), (7, own(30)),  # 7 is a near copy of 1 and also another, clean text
        (None, one), (8, own(40)), (9, None), (None, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(((r.doc_id, r.text) for r in simhash.one_of_each_group(docs).collect()), key=str)
    want = [(None, own(10)), (None, own(11)), (None, own(12)), (5, own(20)), (5, own(21)), (1, one), (7, own(30)), (8, own(40)), (9, None)]
    assert kept == sorted(want, key=str)


def test_rows_that_differ_in_language_only_leave_the_same_one(spark):
    rows = [(1, own(1), lang, n) for n, lang in enumerate(["de", "en", "fr", None])] + [(1, own(1), "en", 1)] * 50 + [(2, own(1), "it", 9), (3, own(5), "pt", 9), (None, None, "x", 1), (None, None, "y", 1)]
    kept = []
    for n in (1, 4, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, row int").repartition(n)
        kept.append(sorted(map(tuple, simhash.one_of_each_group(docs).collect()), key=str))
    assert kept[0] == kept[1] == kept[2] and [r[0] for r in kept[0]] == [1, 3, None] and all(r in rows for r in kept[0])


def library_ids(text, end):
    ids = Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids
    return np.array([*ids, end], "<u4")


def test_added_tokens_as_the_library_reads_them(spark, tmp_path):
    import corpus_pipeline

    mark = "<|endoftext|>"
    texts = [mark, f"a{mark}b", f"one {mark} two", f"x  {mark}{mark}  y", f"{mark[:-3]}", mark[7:] + " rest", f"été{mark}\n\nz 3{mark}", "<|" + mark + "|>", "plain words", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = repair.op6_repair_token_ids(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in got} == {i: (len(x := library_ids(t, 2)), zlib.crc32(x.tobytes())) for i, t in enumerate(texts)}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for got in (packing.op10_cutting_stock_packing(spark, str(tmp_path)).collect(), corpus_pipeline.packing(spark, docs, str(tmp_path)).collect()):
        assert {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in got} == {i: (len(x := library_ids(t, 0)), zlib.crc32(x.tobytes())) for i, t in enumerate(texts)}
