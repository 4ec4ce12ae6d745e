"""Vectorised work on the words of text columns, for use inside Arrow tasks.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; these never occur inside a UTF-8 sequence,
so bytes can stand for characters. All work is on slices of bounded size, a single longer text excepted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once.
SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 12), base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _powers[base] = have
    return have[:n]


class Slice:
    """Texts first..first+len-1 of a batch: their bytes, and the start, end and text of every word."""

    def __init__(self, first: int, data: np.ndarray, bounds: np.ndarray):
        self.first, self.data, self.bounds = first, data, bounds
        self.n_docs = len(bounds) - 1
        n = len(data)
        black = ~((data == 32) | ((data >= 9) & (data <= 13)))
        edge = np.zeros(n + 1, dtype=bool)
        edge[bounds] = True
        before = np.empty(n, dtype=bool)
        if n:
            before[0] = False
            before[1:] = black[:-1]
        self.starts = np.flatnonzero(black & (~before | edge[:n]))
        after = np.empty(n, dtype=bool)
        if n:
            after[-1] = False
            after[:-1] = black[1:]
        self.ends = np.flatnonzero(black & (~after | edge[1:])) + 1
        #: word_bounds[d]..word_bounds[d+1] are the words of text d
        self.word_bounds = np.searchsorted(self.starts, bounds)
        self.n_words = np.diff(self.word_bounds)

    def word_hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        n = len(self.data)
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTES[self.data] * _power(_BASE, n), out=total[1:])
        found = (total[self.ends] - total[self.starts]) * _power(_INVERSE, n + 1)[self.starts]
        return mixed(found + (self.ends - self.starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.n_words)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words that start at each word but the last n - 1."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        out = mixed(out * np.uint64(0xE7037ED1A0B428DB) + words[k : k + m])
    return out


def slices(column: pa.Array, lower: bool = False, limit: int = SLICE) -> Iterator[Slice]:
    """The texts of a string column in slices of about limit bytes; null counts as empty. lower: A-Z count as a-z."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, where, data = column.buffers()
    if not len(column):
        return
    where = np.frombuffer(where, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(where, where[first] + limit, side="right")) - 1)
        last = min(last, len(column))
        piece = data[where[first] : where[last]]
        if lower:
            piece = np.where((piece >= 65) & (piece <= 90), piece + np.uint8(32), piece)
        yield Slice(first, piece, where[first : last + 1] - where[first])
        first = last
