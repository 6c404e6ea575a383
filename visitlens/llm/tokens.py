"""Token ids of whole texts by the tokenizers library, each distinct word encoded once per worker.

A byte-level BPE vocabulary with the usual pre-tokenising pattern never merges across a pre-token, so a
text may be cut wherever the pattern is sure to end one: before white space that follows a visible
character, and between a letter and an ASCII sign or digit. Other places are left whole.

With `special` the added tokens of the file that stand in a text become their ids, as the library does by default: texts
are cut around them first. Without it they are spelled like any other text.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa

from visitlens.llm.common import flat_text, ragged, steps
from visitlens.llm.wordhash import WordCache

_B = np.arange(256)
_WS = np.isin(_B, [9, 10, 13, 32])
_LETTER = ((_B | 32) >= 97) & ((_B | 32) <= 122) & (_B < 128)
_TAIL = (_B >= 0x80) & (_B < 0xC0)
#: What a byte can be, as bits: white space, ASCII letter, visible ASCII, other ASCII, a later byte of a character,
#: the later byte of a Latin-1 letter, the first byte of two (none of these characters is white space), that of Latin-1 letters.
_IS_WS, _IS_LETTER, _IS_GRAPH, _IS_SIGN, _IS_TAIL, _IS_LATIN, _IS_LEAD2, _IS_C3 = (1 << k for k in range(8))
_CLASS = (
    _IS_WS * _WS
    + _IS_LETTER * _LETTER
    + _IS_GRAPH * ((_B > 32) & (_B < 127))
    + _IS_SIGN * ((_B < 128) & ~_LETTER & ~_WS)
    + _IS_TAIL * _TAIL
    + _IS_LATIN * (_TAIL & ~np.isin(_B, [0x97, 0xB7]))
    + _IS_LEAD2 * ((_B >= 0xC3) & (_B < 0xE0))
    + _IS_C3 * (_B == 0xC3)
).astype(np.uint8)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def added_spans(raw: np.ndarray, offsets: np.ndarray, added: re.Pattern | None) -> list[tuple[int, int]]:
    """Where added tokens stand in the documents; none runs over the end of a document."""
    if added is None or not added.search(raw):
        return []
    return [m.span() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for m in added.finditer(raw, a, b)]


def pieces(raw: np.ndarray, offsets: np.ndarray, added: re.Pattern | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of independently encodable pieces, and whether a piece may be joined to others.

    An added token is a piece of its own, never joined.
    """
    n = len(raw)
    c = _CLASS[raw]
    letter = (c & _IS_LETTER) != 0
    letter[1:] |= ((c[:-1] & _IS_C3) != 0) & ((c[1:] & _IS_LATIN) != 0)
    visible = (c & _IS_GRAPH) != 0
    visible[1:] |= ((c[:-1] & _IS_LEAD2) != 0) & ((c[1:] & _IS_TAIL) != 0)
    cut = np.zeros(n, bool)
    cut[1:] = ((c[1:] & _IS_WS) != 0) & visible[:-1] | letter[:-1] & ((c[1:] & _IS_SIGN) != 0)
    cut[offsets[:-1][offsets[:-1] < n]] = True
    spans = added_spans(raw, offsets, added)
    for a, b in spans:
        cut[a:b] = False
        cut[[a, b] if b < n else a] = True
    starts = np.flatnonzero(cut)
    lengths = np.diff(np.append(starts, n))
    joinable = visible[starts + lengths - 1] & ((c[starts] & (_IS_GRAPH | _IS_WS | _IS_LEAD2)) != 0)
    joinable[np.searchsorted(starts, [a for a, _ in spans])] = False
    return starts, lengths, joinable


class Encoder:
    """Documents to ids; `path` is a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, words: int = 1 << 20, special: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True) if special else []
        self.added = re.compile("|".join(map(re.escape, added)).encode()) if added else None
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.width = np.zeros(self.tokenizer.get_vocab_size() + 1, np.int64)
        for token, i in vocab.items():
            self.width[i] = len(token)
        self.newline = vocab["Ċ"]
        self.dtype = np.uint16 if len(self.width) <= 65536 else np.uint32
        self.cache = WordCache(self._compute, self.dtype, words)

    def _alone(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
        return np.array([i for x in ids for i in x], self.dtype), np.array([len(x) for x in ids], np.int64)

    def _compute(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        joinable = self._joinable[np.searchsorted(self._starts, starts)]
        counts, spans = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        parts, base = [], 0
        where = np.flatnonzero(joinable)
        for a in range(0, len(where), 20_000):
            w = where[a : a + 20_000]
            lead = (~_WS[raw[starts[w]]]).astype(np.int64)  # a line break goes before what has no space of its own
            size = lengths[w] + lead
            joined = np.full(int(size.sum()), 10, np.uint8)
            ends = np.cumsum(size)
            joined[ragged(ends - lengths[w], lengths[w])] = raw[ragged(starts[w], lengths[w])]
            ids = np.array(self.tokenizer.encode_batch_fast([joined.tobytes().decode()], add_special_tokens=False)[0].ids, np.int64)
            reach = np.cumsum(self.width[ids])
            stop = np.searchsorted(reach, ends) + 1
            begin = np.concatenate([[0], stop[:-1]]) + lead
            sure = len(reach) > 0 and (stop <= len(reach)).all() and (reach[stop - 1] == ends).all() and (ids[(begin - 1)[lead == 1]] == self.newline).all()
            if not sure:
                joinable[w] = False
                continue
            parts.append(ids.astype(self.dtype))
            counts[w], spans[w] = stop - begin, base + begin
            base += len(ids)
        rest = np.flatnonzero(~joinable)
        if len(rest):
            ids, n = self._alone([raw[starts[i] : starts[i] + lengths[i]].tobytes() for i in rest])
            parts.append(ids)
            counts[rest], spans[rest] = n, base + np.cumsum(n) - n
        pool = np.concatenate(parts) if parts else np.zeros(0, self.dtype)
        return pool[ragged(spans, counts)], counts

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents end to end, and each document's number of ids."""
        docs = len(offsets) - 1
        if not len(raw):
            return np.zeros(0, self.dtype), np.zeros(docs, np.int64)
        self._starts, lengths, self._joinable = pieces(raw, offsets, self.added)
        row = self.cache.rows(raw, self._starts, lengths)
        counts = self.cache.count[row].astype(np.int64)
        ids = self.cache.pool[ragged(self.cache.offset[row], counts)]
        reach = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(reach[np.searchsorted(self._starts, offsets)])

    def batches(self, column: pa.Array):
        """(first row, ids, counts) of consecutive runs of rows of a text column."""
        raw, offsets = flat_text(column)
        try:
            raw.tobytes().decode()
        except UnicodeDecodeError:  # bytes that are no UTF-8 become U+FFFD, as in any decoded text
            texts = [(x or b"").decode("utf-8", "replace").encode() for x in column.cast(pa.binary()).to_pylist()]
            raw, offsets = flat_text(pa.array(texts, pa.large_binary()))
        for a, b in steps(np.diff(offsets)):
            ids, counts = self.encode(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield a, ids, counts


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special: bool = True) -> Encoder:
    """One for each worker process."""
    if (path, special) not in _ENCODERS:
        _ENCODERS[path, special] = Encoder(path, special=special)
    return _ENCODERS[path, special]
