"""Operator 2: SentencePiece encoding and decoding by unigram Viterbi over a double-array trie.

A vocabulary's pieces and log scores make a trie over bytes in two arrays: from node s, byte c leads to base[s] + c if
check says that it came from s. A text gets a leading space; spaces stand for the white-space marker. The best path of
pieces maximises the sum of log scores, the earliest start winning ties. A character that is no piece itself may be
spelt by its bytes, once at ten below the lowest score. Decoding joins the pieces' bytes and takes the leading space
away, so every text comes back as it was, the marker character included (it is spelt in bytes).

Where no piece has a space after another character, paths meet at every space that follows one, and at every character
that no piece holds; the segments between are encoded once per worker, batches of them in step.

Vocabularies of the merge-ranked kind store ranks, no log scores; a piece of rank r then counts as 1 / (r + 1), log-scaled.

Nulls: a null text is an empty one, which has no pieces. Repeated rows stay. Very long segments go through a plain
Viterbi. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitlens.llm.common import flat_text, ragged, steps, table
from visitlens.llm.wordhash import WordCache

MARK = "▁"
#: Bytes of a segment beyond which it is encoded on its own.
LONG = 96


def double_array(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, value) of sorted distinct keys; value[s] is the number of the key that ends at s, or -1. Node 0 is the root."""
    size = 1 << 16
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    check[0] = 0
    low, fresh = 257, 1  # the lowest free place, for single children; where to begin for several
    level = [(0, 0, len(keys), 0)]  # node, keys first .. last - 1, depth
    while level:
        below = []
        for node, a, b, depth in level:
            if len(keys[a]) == depth:
                value[node] = a
                a += 1
            if a == b:
                continue
            heads = np.frombuffer(bytes(k[depth] for k in keys[a:b]), np.uint8)
            first = np.flatnonzero(np.append(True, heads[1:] != heads[:-1]))
            bytes_, ends = heads[first].astype(np.int64), np.append(first[1:], len(heads))
            if low + 1024 > len(check):
                grow = len(check)
                base, value = (np.append(x, np.full(grow, y, np.int32)) for x, y in ((base, 0), (value, -1)))
                check = np.append(check, np.full(grow, -1, np.int32))
            while check[low] >= 0:
                low += 1
            at = max(1, low - int(bytes_[0])) if len(bytes_) == 1 else fresh
            while True:
                if at + 256 > len(check):
                    grow = len(check)
                    base, value = (np.append(x, np.full(grow, y, np.int32)) for x, y in ((base, 0), (value, -1)))
                    check = np.append(check, np.full(grow, -1, np.int32))
                if (check[at + bytes_] < 0).all():
                    break
                at += 1
            base[node] = at
            if len(bytes_) > 1:
                fresh = at + len(bytes_) // 2
            check[at + bytes_] = node
            below += [(at + int(c), a + int(f), a + int(e), depth + 1) for c, f, e in zip(bytes_, first, ends, strict=True)]
        level = below
    used = int(np.flatnonzero(check >= 0)[-1]) + 257
    return tuple(np.append(x, np.full(max(0, used - len(x)), -1, np.int32))[:used] for x in (base, check, value))


@dataclass
class Vocabulary:
    """Pieces as bytes (a space for the marker), their ids and log scores, and the ids that stand for single bytes."""

    texts: list[bytes]
    ids: np.ndarray
    scores: np.ndarray
    byte_ids: np.ndarray
    base: np.ndarray = field(init=False)
    check: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)

    def __post_init__(self):
        order = sorted(range(len(self.texts)), key=self.texts.__getitem__)
        self.texts, self.ids, self.scores = [self.texts[i] for i in order], self.ids[order], self.scores[order]
        self.base, self.check, self.value = double_array(self.texts)
        self.unknown = float(self.scores.min()) - 10
        self.longest = max(map(len, self.texts))
        self.segmented = all(b" " not in t.lstrip(b" ") for t in self.texts)
        self.in_pieces = np.zeros(256, bool)
        self.in_pieces[list(set(b"".join(self.texts)))] = True
        spelt = dict(zip(self.ids.tolist(), self.texts, strict=True)) | {int(i): bytes([b]) for b, i in enumerate(self.byte_ids)}
        self.spelling = np.frombuffer(b"".join(spelt.values()), np.uint8)
        self.spelling_at, self.spelling_size = np.zeros(max(spelt) + 1, np.int64), np.zeros(max(spelt) + 1, np.int64)
        sizes = np.array([len(x) for x in spelt.values()])
        self.spelling_at[list(spelt)], self.spelling_size[list(spelt)] = np.cumsum(sizes) - sizes, sizes


def read_vocabulary(model_file: str) -> Vocabulary:
    """The pieces of a SentencePiece model file that has byte fallback; control and unknown pieces are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    every = range(sp.get_piece_size())
    byte_ids = np.array([i for i in every if sp.is_byte(i)])
    own = np.array([i for i in every if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))])
    scores = np.array([sp.get_score(int(i)) for i in own])
    if (scores == np.round(scores)).all() and len(set(scores)) == len(scores):  # ranks of merges
        rank = np.argsort(np.argsort(-scores)) + 1.0
        scores = -np.log(rank) - np.log((1 / rank).sum())
    return Vocabulary([sp.id_to_piece(int(i)).replace(MARK, " ").encode() for i in own], own, scores, byte_ids)


def viterbi(v: Vocabulary, text: bytes) -> list[int]:
    """The best path of one segment, plainly."""
    n = len(text)
    best, back, piece = [-np.inf] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    best[0] = 0.0
    base, check, value, scores = v.base, v.check, v.value, v.scores
    for i in range(n):
        if best[i] == -np.inf:
            continue
        lead = not 0x80 <= text[i] < 0xC0
        single = False
        if lead:
            width = 1
            while i + width < n and 0x80 <= text[i + width] < 0xC0:
                width += 1
            node = 0
            for j in range(i, min(n, i + v.longest)):
                to = int(base[node]) + text[j]
                if check[to] != node or to == 0:
                    break
                node = to
                k = int(value[node])
                if k >= 0:
                    single |= j + 1 == i + width
                    if best[i] + scores[k] > best[j + 1]:
                        best[j + 1], back[j + 1], piece[j + 1] = best[i] + scores[k], i, v.ids[k]
        if not single:
            s = best[i] + (v.unknown if lead else 0.0)
            if s > best[i + 1]:
                best[i + 1], back[i + 1], piece[i + 1] = s, i, v.byte_ids[text[i]]
    out, at = [], n
    while at:
        out.append(int(piece[at]))
        at = back[at]
    return out[::-1]


def viterbi_batch(v: Vocabulary, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As viterbi for many segments in step: (ids of all, number of ids of each)."""
    w, top = len(starts), int(lengths.max())
    text = np.zeros((w, top + 1), np.uint8)
    text[np.repeat(np.arange(w), lengths), ragged(np.zeros(w, np.int64), lengths)] = raw[ragged(starts, lengths)]
    later = (text >= 0x80) & (text < 0xC0)
    best, back, piece = np.full((w, top + 1), -np.inf), np.zeros((w, top + 1), np.int32), np.zeros((w, top + 1), np.int32)
    best[:, 0] = 0.0
    for i in range(top):
        on = np.flatnonzero((lengths > i) & (best[:, i] > -np.inf))
        if not len(on):
            continue
        lead = ~later[on, i]
        single = np.zeros(w, bool)
        rows, node = on[lead], np.zeros(int(lead.sum()), np.int64)
        j = i
        while len(rows):
            to = v.base[node].astype(np.int64) + text[rows, j]
            go = (v.check[to] == node) & (to != 0)
            rows, node = rows[go], to[go]
            j += 1
            k = v.value[node]
            hit = k >= 0
            r, k = rows[hit], k[hit]
            single[r] |= ~later[r, j]
            s = best[r, i] + v.scores[k]
            better = s > best[r, j]
            r, k = r[better], k[better]
            best[r, j], back[r, j], piece[r, j] = s[better], i, v.ids[k]
            more = lengths[rows] > j
            rows, node = rows[more], node[more]
        spell = ~single[on]
        r = on[spell]
        s = best[r, i] + np.where(lead[spell], v.unknown, 0.0)
        better = s > best[r, i + 1]
        r = r[better]
        best[r, i + 1], back[r, i + 1], piece[r, i + 1] = s[better], i, v.byte_ids[text[r, i]]
    at, live, taken, counts = lengths.astype(np.int64).copy(), np.arange(w), [], np.zeros(w, np.int64)
    while len(live):
        taken.append((live, piece[live, at[live]]))
        counts[live] += 1
        at[live] = back[live, at[live]]
        live = live[at[live] > 0]
    out, end = np.zeros(int(counts.sum()), np.int32), np.cumsum(counts)
    for k, (rows, ids) in enumerate(taken):
        out[end[rows] - 1 - k] = ids
    return out, counts


class PieceEncoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.cache = WordCache(self._compute, np.int32, 800_000)

    def _compute(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts, spans, parts, done = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), [], 0
        order = np.argsort(lengths, kind="stable")
        short = order[lengths[order] <= LONG]
        for a in range(0, len(short), 1 << 15):
            rows = short[a : a + (1 << 15)]
            ids, n = viterbi_batch(self.v, raw, starts[rows], lengths[rows])
            parts.append(ids)
            counts[rows], spans[rows] = n, done + np.cumsum(n) - n
            done += len(ids)
        for i in order[len(short) :]:
            ids = viterbi(self.v, raw[starts[i] : starts[i] + lengths[i]].tobytes())
            parts.append(np.array(ids, np.int32))
            counts[i], spans[i] = len(ids), done
            done += len(ids)
        pool = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        return pool[ragged(spans, counts)], counts

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents end to end, and each document's number of ids."""
        sizes = np.diff(offsets)
        lead = (sizes > 0).astype(np.int64)  # an empty text gets no leading space
        at = np.concatenate([[0], np.cumsum(sizes + lead)])
        spaced = np.full(int(at[-1]), 32, np.uint8)
        spaced[ragged(at[:-1] + lead, sizes)] = raw
        if not len(spaced):
            return np.zeros(0, np.int32), np.zeros(len(sizes), np.int64)
        cut = np.zeros(len(spaced), bool)
        if self.v.segmented:
            cut[1:] = (spaced[1:] == 32) & (spaced[:-1] != 32)
            alone = ~self.v.in_pieces[spaced] & (spaced < 128)
            cut |= alone
            cut[1:] |= alone[:-1]
        cut[at[:-1][sizes > 0]] = True
        starts = np.flatnonzero(cut)
        row = self.cache.rows(spaced, starts, np.diff(np.append(starts, len(spaced))))
        counts = self.cache.count[row].astype(np.int64)
        ids = self.cache.pool[ragged(self.cache.offset[row], counts)]
        reach = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(reach[np.searchsorted(starts, at)])


def decode(v: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all documents end to end, and each document's number of bytes; the leading space is taken away."""
    size = v.spelling_size[ids]
    flat = v.spelling[ragged(v.spelling_at[ids], size)]
    reach = np.concatenate([[0], np.cumsum(size)])
    ends = reach[np.concatenate([[0], np.cumsum(counts)])]
    keep = np.ones(len(flat), bool)
    begin = ends[:-1][counts > 0]
    drop = begin[flat[begin] == 32]
    keep[drop] = False
    kept = np.concatenate([[0], np.cumsum(keep)])
    return flat[keep], np.diff(kept[ends])


_ENCODERS: dict[str, PieceEncoder] = {}


def _binary(data: np.ndarray, counts: np.ndarray, width: int) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(counts) * width]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def encode_documents(docs: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, crc32 of the text, ids): ids as little-endian 32-bit integers; vocabulary: a broadcast Vocabulary."""
    import uuid

    tag = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tag not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[tag] = PieceEncoder(vocabulary.value)
        for batch in batches:
            raw, offsets = flat_text(batch.column(2))
            for a, b in steps(np.diff(offsets)):
                ids, counts = _ENCODERS[tag].encode(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.record_batch([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), _binary(ids.astype("<i4"), counts, 4)], names=["doc_id", "text_crc32", "ids"])

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.crc32(text).alias("text_crc32"), text.alias("text")).mapInArrow(run, "doc_id bigint, text_crc32 bigint, ids binary")


def decode_documents(encoded: DataFrame, vocabulary) -> DataFrame:
    """The columns of an encoded table, and text: what its ids spell."""
    columns = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for batch in batches:
            flat, offsets = flat_text(batch.column(columns.index("ids")))
            for a, b in steps(np.diff(offsets)):
                ids = np.ascontiguousarray(flat[offsets[a] : offsets[b]]).view("<i4")
                data, sizes = decode(v, ids, np.diff(offsets[a : b + 1]) // 4)
                yield pa.record_batch([*(c.slice(a, b - a) for c in batch.columns), _binary(data, sizes, 1)], names=[*columns, "text"])

    decoded = encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("text", T.BinaryType())]))
    return decoded.withColumn("text", F.col("text").cast("string"))


def op2_sentencepiece_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = spark.sparkContext.broadcast(read_vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    decoded = decode_documents(encode_documents(table(spark, sf_dir, "documents"), vocabulary), vocabulary)
    text_crc32 = F.crc32(F.col("text").cast("binary"))
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_pieces"),
        F.crc32("ids").alias("ids_crc32"),
        F.octet_length("text").cast("bigint").alias("decoded_bytes"),
        text_crc32.alias("decoded_crc32"),
        (text_crc32 == F.col("text_crc32")).alias("same_text"),
    )
