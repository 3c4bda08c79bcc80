"""Vectorised tokenising and hashing of Arrow batches, for use inside tasks.

A batch's text column is read as one byte buffer with offsets. Words, their hashes and n-gram hashes are computed with
numpy over slices of about ``SLICE`` bytes (a longer text is a slice of its own), so memory does not depend on the
number of rows in a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))
_RNG = np.random.Generator(np.random.PCG64(20240607))
_T64 = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _table(is_word, lower: bool = True) -> np.ndarray:
    t = np.zeros(256, np.uint8)
    for b in range(256):
        low = b + 32 if lower and 0x41 <= b <= 0x5A else b
        t[b] = low if is_word(low) else 0
    return t


#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z: digits, a-z and everything beyond ASCII.
WORD = _table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
#: Everything that is not ASCII white space.
VISIBLE = _table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D or b == 0))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads all 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of the hash base and of its inverse, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, SLICE * 2)
            up, down = np.full(n, _R, np.uint64), np.full(n, _R_INV, np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        return self.up, self.down


_POWERS = _Powers()


@dataclass
class Words:
    """Words of rows ``first`` to ``first + n_rows``: byte ranges in ``data``, row of each word, 64-bit hashes."""

    first: int
    n_rows: int
    data: np.ndarray  # mapped bytes of the slice
    bounds: np.ndarray  # row starts in data, n_rows + 1
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray  # 0-based within the slice
    hash: np.ndarray
    word_bounds: np.ndarray  # for each row the range of its words, n_rows + 1

    def position(self) -> np.ndarray:
        """Number of each word within its row."""
        return np.arange(len(self.row)) - self.word_bounds[self.row]

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of ``k`` words of one row, and the index of its first word."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        g = self.hash[:n].copy()
        for j in range(1, k):
            g *= _R
            g += self.hash[j : j + n]
        at = np.flatnonzero(self.row[:n] == self.row[k - 1 :])
        return mix(g[at]), at


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw, off


def slices(off: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes, at least a row each."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the byte polynomial (one longer than data), and the inverse powers."""
    up, down = _POWERS.get(len(data) + 1)
    p = np.empty(len(data) + 1, np.uint64)
    p[0] = 0
    np.cumsum(_T64[data] * up[: len(data)], dtype=np.uint64, out=p[1:])
    return p, down


def words(column: pa.Array, table: np.ndarray = WORD, kinds: np.ndarray | None = None) -> Iterator[Words]:
    """The words of a text column, slice by slice. ``kinds``: class of each byte; a word also ends where it changes."""
    raw, off = string_buffers(column)
    for i, j in slices(off):
        part = raw[off[i] : off[j]]
        bounds = off[i : j + 1] - off[i]
        low = table[part]
        n = len(low)
        inside = low != 0
        first = np.zeros(n + 1, bool)
        first[bounds] = True
        joined = np.zeros(n + 1, bool)  # whether byte i goes on with the word of byte i - 1
        if n:
            joined[1:n] = inside[1:] & inside[:-1]
            if kinds is not None:
                k = kinds[part]
                joined[1:n] &= k[1:] == k[:-1]
            joined &= ~first
        start = np.flatnonzero(inside & ~joined[:n])
        end = np.flatnonzero(inside & ~joined[1:]) + 1
        p, down = prefix_hash(low)
        h = mix((p[end] - p[start]) * down[start] + (end - start).astype(np.uint64))
        row = np.searchsorted(bounds, start, side="right") - 1
        yield Words(i, j - i, low, bounds, start, end, row, h, np.searchsorted(row, np.arange(j - i + 1)))


def in_sorted(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Index of each value in the sorted array ``known``, -1 if it isn't there."""
    if not len(known):
        return np.full(len(values), -1, np.int64)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return np.where(known[at] == values, at, -1)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
