"""Words of a flat byte buffer as two 64-bit hashes, and an open-addressing table over them in numpy.

Per-word results (token ids, log-likelihoods, features) are computed once for each distinct word that
a task meets and looked up for all others, without a Python object for each word.
"""

from __future__ import annotations

import numpy as np
import xxhash

from visitlens.llm.common import ragged

_M = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_S = np.uint64(29)
#: Bytes beyond which a word is hashed on its own.
_LONG = 512
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], dtype=np.uint64)


def word_hashes(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of raw[start:start+length]; equal bytes give equal hashes. None is 0."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded.data, strides=(1,))
    n = len(starts)
    h1 = (lengths.astype(np.uint64) + np.uint64(1)) * _M[0]
    h2 = (lengths.astype(np.uint64) + np.uint64(7)) * _M[1]
    active = slice(None)
    at, left = starts.astype(np.int64), lengths.astype(np.int64)
    while True:
        x = lanes[at] & _KEEP[np.minimum(left, 8)]
        for h, m in ((h1, _M[0]), (h2, _M[1])):
            y = (h[active] ^ x) * m
            y ^= y >> _S
            h[active] = y * m
        more = np.flatnonzero((left > 8) & (left <= _LONG)) if isinstance(active, slice) else np.flatnonzero(left > 8)
        if not len(more):
            break
        active = more if isinstance(active, slice) else active[more]
        at, left = at[more] + 8, left[more] - 8
    for i in np.flatnonzero(lengths > _LONG):
        d = xxhash.xxh3_128_intdigest(raw[starts[i] : starts[i] + lengths[i]].tobytes())
        h1[i], h2[i] = d & (2**64 - 1), d >> 64
    h1[h1 == 0] = 1
    return h1, h2


def words_between(sep: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the runs without separators, none across an offset, and the words' document indices."""
    n = len(sep)
    inside = ~sep
    begin = inside.copy()
    begin[1:] &= sep[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < n]
    begin[edges] = inside[edges]
    starts = np.flatnonzero(begin)
    stop = np.append(sep, True)
    stop[:-1] |= begin
    at = np.flatnonzero(stop)
    ends = at[np.searchsorted(at, starts, side="right")]
    return starts, ends - starts, np.searchsorted(offsets, starts, side="right") - 1


class HashTable:
    """Two hashes -> a row number, with vectorised probing; `rows` counts what is in it."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.bits = max(4, int(np.ceil(np.log2(capacity * 2))))
        self.clear()

    def clear(self) -> None:
        size = 1 << self.bits
        self.key, self.check, self.value, self.rows = np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.zeros(size, np.int32), 0

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The row of each, or -1."""
        out = np.full(len(h1), -1, np.int32)
        todo, slot, mask = np.arange(len(h1)), self._slot(h1), (1 << self.bits) - 1
        a, b = h1, h2
        while len(todo):
            k = self.key[slot]
            hit = (k == a) & (self.check[slot] == b)
            out[todo[hit]] = self.value[slot[hit]]
            go = np.flatnonzero(~hit & (k != 0))
            todo, slot, a, b = todo[go], (slot[go] + 1) & mask, a[go], b[go]
        return out

    def add(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Adds distinct new keys as rows `rows`, `rows` + 1, ...; returns the row numbers."""
        new = np.arange(self.rows, self.rows + len(h1), dtype=np.int32)
        todo, slot, mask = np.arange(len(h1)), self._slot(h1), (1 << self.bits) - 1
        while len(todo):
            free = self.key[slot] == 0
            self.value[slot[free]] = -1 - todo[free].astype(np.int32)  # the last writer of a slot gets it
            won = free.copy()
            won[free] = self.value[slot[free]] == -1 - todo[free].astype(np.int32)
            i, s = todo[won], slot[won]
            self.key[s], self.check[s], self.value[s] = h1[i], h2[i], new[i]
            todo, slot = todo[~won], (slot[~won] + 1) & mask
        self.rows += len(h1)
        return new


def distinct(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of one word of each distinct hash, and for each word the number of its distinct hash."""
    _, first, inverse = np.unique(h1, return_index=True, return_inverse=True)
    if (h2 != h2[first][inverse]).any():  # two words with one first hash: the second tells them apart
        _, first, inverse = np.unique(np.stack([h1, h2], 1), axis=0, return_index=True, return_inverse=True)
    return first, inverse.ravel()


class WordCache:
    """Spans of values for each distinct word. compute(raw, starts, lengths) gives (values, counts) for new words. When it is full,
    words that were met again since they came in, or since it was last full, stay, but fill no more than half of it."""

    def __init__(self, compute, dtype, capacity: int = 1_000_000, pool: int = 8_000_000):
        self.compute, self.dtype, self.pool_limit = compute, dtype, pool
        self.table = HashTable(capacity)
        self.clear()

    def clear(self) -> None:
        self.table.clear()
        self.pool, self.used = np.zeros(1 << 16, self.dtype), 0
        self.offset, self.count = np.zeros(self.table.capacity + 1, np.int64), np.zeros(self.table.capacity + 1, np.int32)
        self.again = np.zeros(self.table.capacity + 1, bool)

    def _thin(self) -> None:
        """Leaves words that were met again, as rows 0, 1, ..."""
        slots = np.flatnonzero(self.table.key)
        slots = slots[self.again[self.table.value[slots]]]
        filled = np.cumsum(self.count[self.table.value[slots]], dtype=np.int64)
        slots = slots[: min(self.table.capacity // 2, int(np.searchsorted(filled, self.pool_limit // 2, side="right")))]
        h1, h2, rows = self.table.key[slots], self.table.check[slots], self.table.value[slots]
        counts = self.count[rows].astype(np.int64)
        values = self.pool[ragged(self.offset[rows], counts)]
        self.clear()
        self._add(h1, h2, values, counts)

    def _add(self, h1: np.ndarray, h2: np.ndarray, values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        new = self.table.add(h1, h2)
        need = self.used + len(values)
        if need > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), need - len(self.pool)), self.dtype)])
        self.pool[self.used : need] = values
        self.offset[new], self.count[new] = self.used + np.cumsum(counts) - counts, counts
        self.used = need
        return new

    def rows(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Row of each word; offset[row] and count[row] give its span in pool."""
        h1, h2 = word_hashes(raw, starts, lengths)
        row = self.table.find(h1, h2)
        self.again[row] = True  # of missing words the last, which is no row
        missing = np.flatnonzero(row < 0)
        if len(missing):
            first, inverse = distinct(h1[missing], h2[missing])
            if self.table.rows + len(first) > self.table.capacity or self.used > self.pool_limit:
                self._thin()
                row = self.table.find(h1, h2)
                missing = np.flatnonzero(row < 0)
                first, inverse = distinct(h1[missing], h2[missing])
                if self.table.rows + len(first) > self.table.capacity:
                    self.clear()
                    missing = np.arange(len(row))
                    first, inverse = distinct(h1, h2)
                    if len(first) > self.table.capacity:
                        self.table = HashTable(len(first))
                        self.clear()
            pick = missing[first]
            values, counts = self.compute(raw, starts[pick], lengths[pick])
            row[missing] = self._add(h1[pick], h2[pick], values, counts)[inverse]
        return row
