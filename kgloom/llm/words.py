"""Words of Arrow text columns as numpy arrays, many documents at a time.

The hashes are 64-bit and the same in every process: a polynomial over the
bytes of a word, mixed, and combined over consecutive words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that are worked on at once; a longer document is worked on alone.
SLICE_BYTES = 2 << 20

_BASE, _STEP = 0x9E3779B97F4A7C55, 0xD6E8FEB86659FD93
_U = np.uint64


def _table(*ranges: tuple[int, int]) -> np.ndarray:
    word = np.ones(256, bool)
    for a, b in ranges:
        word[a : b + 1] = False
    return word


#: Whether a byte belongs to a word, for `[^\x20\x09-\x0D]+`.
BY_SPACE = _table((0x20, 0x20), (0x09, 0x0D))
#: The same for `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z are lowered.
BY_ALNUM = _table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose low and high bits depend on all bits."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


#: Bytes whose words are hashed at once.
_CHUNK = 1 << 17


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for the bytes of two chunks."""
    n = 2 * _CHUNK
    up, down = np.empty(n, _U), np.empty(n, _U)
    for out, b in ((up, _BASE), (down, pow(_BASE, -1, 1 << 64))):
        out[0], k = 1, 1
        while k < n:  # doubling: the second half is the first times b^k
            m = min(k, n - k)
            out[k : k + m] = out[:m] * _U(pow(b, k, 1 << 64))
            k += m
    return up, down


class Words:
    """The words of some documents: `start` and `end` bytes of each word, `first[i]:first[i + 1]` the words of document i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, lower: bool) -> None:
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        inside = is_word[self.data]
        begins, ends = inside.copy(), inside.copy()
        if len(inside):
            begins[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            edges = offsets[(offsets > 0) & (offsets < len(inside))]
            begins[edges] = inside[edges]
            ends[edges - 1] = inside[edges - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    @property
    def left(self) -> np.ndarray:
        """How many words of its document each word is followed by, itself included."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.start))

    def hashes(self) -> np.ndarray:
        up, down = _powers()
        out, i, n = np.empty(len(self.start), _U), 0, len(self.start)
        while i < n:
            begin = int(self.start[i])
            j = int(np.searchsorted(self.start, begin + _CHUNK))
            stop = int(self.end[j - 1])
            if stop - begin > len(up):  # the last word is longer than a chunk
                j, stop = j - 1, int(self.end[j - 2]) if j - 1 > i else begin
            if j > i:
                sums = np.zeros(stop - begin + 1, _U)
                np.cumsum((self.data[begin:stop].astype(_U) + _U(1)) * up[: stop - begin], out=sums[1:])
                out[i:j] = (sums[self.end[i:j] - begin] - sums[self.start[i:j] - begin]) * down[self.start[i:j] - begin]
            else:
                out[i], j = self._long(i), i + 1
            i = j
        return mix(out)

    def _long(self, i: int) -> np.uint64:
        """The sum of a word that is longer than a chunk."""
        up, total = _powers()[0], 0
        for at in range(int(self.start[i]), int(self.end[i]), _CHUNK):
            part = self.data[at : min(at + _CHUNK, int(self.end[i]))].astype(_U) + _U(1)
            total += int((part * up[: len(part)]).sum()) * pow(_BASE, at - int(self.start[i]), 1 << 64)
        return _U(total % (1 << 64))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words, one for each start; windows over the end of a document are the caller's to drop."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, _U)
    out, c = np.zeros(n, _U), 1
    for i in range(k):
        out += h[i : i + n] * _U(c)
        c = c * _STEP % (1 << 64)
    return mix(out + _U(k))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most `limit` bytes each, or one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_slices(batch: pa.RecordBatch, is_word: np.ndarray, lower: bool, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) of slices of a batch."""
    data, offsets = utf8(batch.column(column))
    for i, j in slices(offsets, limit):
        part = offsets[i : j + 1]
        yield i, j, Words(data[part[0] : part[-1]], part - part[0], is_word, lower)
