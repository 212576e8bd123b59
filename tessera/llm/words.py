"""Vectorised word and shingle hashing over Arrow string buffers.

Words are maximal runs of non-separator bytes; every byte of a batch is handled in NumPy, so
whole texts of any length are read once without a Python loop over words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
SPAN = 1 << 15  # bytes hashed at a time, so that the arrays stay in the CPU caches


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, a bijection on 64 bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BASE = 0x9E3779B97F4A7C15 | 1
BYTES = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 2 * SPAN)
        have = np.full(size, base % (1 << 64), dtype=U)
        have[0] = 1
        have = np.cumprod(have, dtype=U)
        if size <= 64 * SPAN:
            _powers[base] = have
    return have


INVERSE = pow(BASE, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: White space of the contracts: space and 0x09-0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: ASCII other than letters and digits separates words: punctuation is no part of a word.
PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows and the rows' offsets in them; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]] if len(off) else raw[:0], off - off[0] if len(off) else np.zeros(1, np.int64)


def spans(raw: np.ndarray, off: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row (plus one) the index of its first word."""
    inside = np.zeros(len(raw) + 1, dtype=bool)
    np.logical_not(separators[raw], out=inside[:-1])
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[off] = True
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (edge | ~before))
    ends = np.flatnonzero(before & (edge | ~inside))
    return starts, ends, np.searchsorted(starts, off)


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, ASCII letters folded to lower case."""
    out = np.empty(len(starts), dtype=U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SPAN, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        up = powers(BASE, b - a + 1)
        total = np.zeros(b - a + 1, dtype=U)
        np.cumsum(BYTES[LOWER[raw[a:b]]] * up[: b - a], dtype=U, out=total[1:])
        out[i:j] = (total[ends[i:j] - a] - total[starts[i:j] - a]) * powers(INVERSE, b - a + 1)[starts[i:j] - a]
        i = j
    return mix(out + U(0x632BE59BD9B4E019) * (ends - starts).astype(U))


def words(column: pa.Array, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each row (plus one) the index of its first word."""
    raw, off = buffers(column)
    starts, ends, first = spans(raw, off, separators)
    return hashes(raw, starts, ends), first


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k consecutive words, at every position that has k words after it."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    out = np.full(n, U(k), dtype=U)
    for i in range(k):
        out = mix(out * U(0x9FB21C651E98DF25) + h[i : i + n])
    return out


def shingles(h: np.ndarray, first: np.ndarray, k: int):
    """Yields each row's sorted distinct k-word shingles; a row of fewer words has its whole sequence as one."""
    all_grams = grams(h, k)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            s = np.sort(all_grams[a : b - k + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            yield grams(h[a:b], int(b - a))
        else:
            yield np.zeros(0, dtype=U)


class Memo:
    """Numbers by 64-bit hash, open-addressed and vectorised; forgets all beyond `kept` keys."""

    def __init__(self, kept: int):
        self.kept = kept
        self.forget()

    def forget(self) -> None:
        self.keys, self.values = np.zeros(0, U), np.zeros(0, np.int64)
        self.slots = np.full(1 << 16, -1, dtype=np.int32)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        first = len(self.keys)
        self.keys, self.values = np.concatenate((self.keys, keys)), np.concatenate((self.values, values))
        if 2 * len(self.keys) > len(self.slots):
            self.slots, first = np.full(1 << (4 * len(self.keys)).bit_length(), -1, dtype=np.int32), 0
        i = np.arange(first, len(self.keys), dtype=np.int32)
        slot = (self.keys[i] & U(len(self.slots) - 1)).astype(np.int64)
        while len(i):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = i[free]
            left = self.slots[slot] != i
            i, slot = i[left], (slot[left] + 1) & (len(self.slots) - 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Each hash's place, or -1."""
        slot = (h & U(len(self.slots) - 1)).astype(np.int64)
        out = self.slots[slot]
        if not len(self.keys):
            return out
        bad = np.flatnonzero((self.keys[out] != h) & (out >= 0))
        while len(bad):
            slot[bad] = (slot[bad] + 1) & (len(self.slots) - 1)
            out[bad] = self.slots[slot[bad]]
            bad = bad[(out[bad] >= 0) & (self.keys[out[bad]] != h[bad])]
        return out

    def get(self, h: np.ndarray, make) -> np.ndarray:
        """Each hash's number; make(indexes) gives the numbers of hashes that are new."""
        if len(self.keys) > self.kept:
            self.forget()
        place = self.find(h)
        unknown = np.flatnonzero(place < 0)
        if len(unknown):
            new, first = np.unique(h[unknown], return_index=True)
            self.put(new, make(unknown[first]))
            place[unknown] = self.find(h[unknown])
        return self.values[place]
