"""Texts of a batch as one flat byte array, and hashes of its spans, words and word sequences.

All functions work on whole batches with numpy. A span's hash is a polynomial over random byte values modulo 2**64, read
off running sums, so that the hash of any span costs two lookups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
#: Texts are worked on in lots of about so many bytes; a longer text is a lot of its own.
LOT_BYTES = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values(fold: bool = False) -> np.ndarray:
    """A random value per byte; with fold, A-Z get those of a-z."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    if fold:
        values[65:91] = values[97:123]
    return values


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, 1 << 64))
        take = min(done, n - done)
        out[done : done + take] = out[:take] * step
        done += take
    return out[:n]


class Spans:
    """Hashes of spans of one byte array."""

    def __init__(self, data: np.ndarray, values: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        if n:
            np.cumsum(values[data] * powers(BASE, n), out=self.sums[1:])
        self.back = powers(pow(BASE, -1, 1 << 64), n + 1)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])

    def fixed(self, length: int) -> np.ndarray:
        """The hash of every span of this length, by start."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mix((self.sums[length:] - self.sums[:n]) * self.back[:n])


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, one after the other, and the n + 1 offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        column = pa.array([], column.type)
    column = column.cast(pa.large_binary()).fill_null(b"")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if len(offsets) == 0 or buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def text_lots(offsets: np.ndarray, size: int = LOT_BYTES) -> list[tuple[int, int]]:
    """Ranges of consecutive texts (from, to) of about `size` bytes."""
    out, begin = [], 0
    while begin < len(offsets) - 1:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + size, side="right")) - 1)
        out.append((begin, end))
        begin = end
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every maximal run of bytes outside space and 0x09-0x0D."""
    solid = (data != 32) & ((data < 9) | (data > 13))
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    first[inner] = solid[inner]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = solid[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles of each document, sorted; a shorter text is one shingle, no words none."""
    start, end, doc = words(data, offsets)
    if len(start) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    one = Spans(data, byte_values(fold=True)).hash(start, end)
    count = np.bincount(doc, minlength=len(offsets) - 1)
    begin = np.concatenate(([0], np.cumsum(count)))
    place = np.arange(len(doc)) - begin[doc]
    head = place <= np.maximum(count[doc] - size, 0)
    at = np.flatnonzero(head)
    width = np.minimum(count[doc[at]], size)
    out = width.astype(np.uint64)
    for i in range(size):
        inside = i < width
        step = one[np.minimum(at + i, len(one) - 1)]
        out = np.where(inside, mix(out * np.uint64(BASE) + step), out)
    owner = doc[at]
    order = np.lexsort((out, owner))
    owner, out = owner[order], out[order]
    fresh = np.ones(len(out), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (out[1:] != out[:-1])
    return owner[fresh], out[fresh]


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every maximal run of ASCII letters and bytes of further characters."""
    solid = (data >= 128) | ((data | 32) >= 97) & ((data | 32) <= 122)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a run ends where its document does
    before = np.r_[False, solid[:-1]] & ~edge[: len(data)]
    after = np.r_[solid[1:], False] & ~edge[1:]
    start, end = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1
