"""Numpy kernels over Arrow string buffers: words, word hashes and shingles of whole texts.

Words are runs of bytes other than ASCII white space. A word's hash is a polynomial
over its bytes modulo 2**64, read off prefix sums, so no Python string is made.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift-multiply); a bijection, so it adds no collisions."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    p = np.full(SLICE + 1, _BASE, np.uint64)
    q = np.full(SLICE + 1, inverse, np.uint64)
    p[0] = q[0] = 1
    return np.multiply.accumulate(p), np.multiply.accumulate(q)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, at, data = column.buffers()
    off = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def row_groups(off: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``most`` bytes together; a longer row stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, off: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, word offsets by row, starts, ends) of the words of consecutive rows."""
    h, starts, ends = _raw_words(data, off, lower) if len(data) <= SLICE else _long_words(data, off, lower)
    return mix(h), np.searchsorted(starts, off), starts, ends


def _raw_words(data: np.ndarray, off: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(polynomials, starts, ends) of the words of at most a slice."""
    if lower:
        data = LOWER[data]
    blank = SPACE[data]
    first = ~blank
    last = first.copy()
    first[1:] &= blank[:-1]
    last[:-1] &= blank[1:]
    inner = off[(off > 0) & (off < len(data))]
    first[inner] = ~blank[inner]
    last[inner - 1] = ~blank[inner - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    p, q = powers()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=sums[1:])
    return (sums[ends] - sums[starts]) * q[starts], starts, ends


def _long_words(data: np.ndarray, off: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for more than a slice: a word that a slice's end cuts is put together again,
    its parts' polynomials shifted by the length of what precedes them."""
    rows = set(off.tolist())
    hs: list[np.ndarray] = []
    ss: list[np.ndarray] = []
    es: list[np.ndarray] = []
    for a in range(0, len(data), SLICE):
        b = min(len(data), a + SLICE)
        h, s, e = _raw_words(data[a:b], off[(off > a) & (off < b)] - a, lower)
        s, e = s + a, e + a
        if es and len(s) and s[0] == a == es[-1][-1] and a not in rows:
            hs[-1][-1:] += h[:1] * np.uint64(pow(_BASE, a - int(ss[-1][-1]), 1 << 64))
            es[-1][-1] = e[0]
            h, s, e = h[1:], s[1:], e[1:]
        if len(s):
            hs.append(h), ss.append(s), es.append(e)
    if not hs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hs), np.concatenate(ss), np.concatenate(es)


def shingles(h: np.ndarray, at: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row of each) of all runs of ``size`` words. A row of fewer words has the one
    shingle of all its words; a row without words has none."""
    n = len(h)
    rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
    if not n:
        return np.zeros(0, np.uint64), rows
    total = np.zeros(n, np.uint64)
    left = np.repeat(at[1:], np.diff(at)) - np.arange(n)
    for k in range(size):
        moved = np.zeros(n, np.uint64)
        moved[: n - k] = h[k:]
        total = total * np.uint64(_BASE) + np.where(left > k, moved, np.uint64(0))
    first = np.zeros(n, bool)
    first[at[:-1][np.diff(at) > 0]] = True
    keep = (left >= size) | (first & (left < size))
    return mix(total[keep]), rows[keep]


def finishing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches``; then freed memory goes back to the system, since an idle Python worker
    lives on beside those of later stages with all it ever held."""
    yield from batches
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
