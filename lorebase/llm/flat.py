"""Words of whole Arrow text columns as flat numpy arrays: no Python object is made per word or per character."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts are worked on in blocks of at most this many bytes (a longer text is a block of its own).
BLOCK_BYTES = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of `[^\x20\x09-\x0D]+`.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (every byte of a non-ASCII character belongs to a word).
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64-bit values (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def changes(s: np.ndarray) -> np.ndarray:
    """Whether each value differs from the one before it (the first does)."""
    out = np.ones(len(s), bool)
    np.not_equal(s[1:], s[:-1], out=out[1:])
    return out


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct integers, by a sort: numpy's own unique hashes integers, which takes many times as long."""
    s = np.sort(x)
    return s[changes(s)]


@dataclass
class Words:
    """Words of the texts of one block: `first[i]:first[i + 1]` are the words of text i."""

    data: np.ndarray  # lower-cased bytes of the block
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        size = self.end - self.start
        if not len(size):
            return np.zeros(0, np.uint64)
        before = np.cumsum(size) - size
        within = np.arange(size.sum()) - np.repeat(before, size)
        power = np.cumprod(np.full(int(size.max()) + 1, _BASE))
        value = (self.data[within + np.repeat(self.start, size)].astype(np.uint64) + np.uint64(1)) * power[within]
        return mix(np.add.reduceat(value, before))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets into the bytes) of runs of rows; a null is an empty text."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + BLOCK_BYTES, "right")) - 1)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def words(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """Maximal runs of bytes marked in `inside` after A-Z is lower-cased; a run never spans two texts."""
    data = LOWER[raw]
    mark = inside[data]
    before = np.empty_like(mark)
    before[:1] = False
    before[1:] = mark[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    before[edge] = False
    start = np.flatnonzero(mark & ~before)
    after = np.empty_like(mark)
    after[-1:] = False
    after[:-1] = mark[1:]
    after[edge[edge > 0] - 1] = False
    end = np.flatnonzero(mark & ~after) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k consecutive words from each position (the last k - 1 positions have none)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(k))
    for j in range(k):
        out = (out + hashes[j : j + n]) * _BASE
        out ^= out >> np.uint64(29)
    return mix(out)
