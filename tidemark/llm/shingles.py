"""Word shingles of Arrow string columns, hashed with numpy without a Python object per word.

Words are runs of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z. All
these are single bytes in UTF-8, so the column's bytes are worked on directly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 21

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every range of bits is usable on its own."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = CHUNK_BYTES if n <= CHUNK_BYTES else n
    if size not in _powers:
        tables = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        if size != CHUNK_BYTES:
            return tables[0], tables[1]
        _powers[size] = (tables[0], tables[1])
    return _powers[size]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null rows are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offs


def chunks(offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes, or of one longer row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def word_hashes(b: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of rows that lie end to end in ``b``, and each row's first word."""
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    word = _IS_WORD[b]
    starts, ends = word.copy(), word.copy()
    starts[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    edges = bounds[:-1][bounds[:-1] < len(b)]
    starts[edges] = word[edges]
    edges = edges[edges > 0]
    ends[edges - 1] = word[edges - 1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends)
    power, inverse = _power_tables(len(b))
    total = np.cumsum(_BYTE[b] * power[: len(b)], dtype=np.uint64)
    before = np.where(first > 0, total[np.maximum(first - 1, 0)], np.uint64(0))
    hashes = mix((total[last] - before) * inverse[first])
    return hashes, np.searchsorted(first, bounds)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each row, its distinct hashed ``k``-word shingles in ascending order.

    A row of fewer words is one shingle, and a row without words has none.
    """
    data, offs = utf8(column)
    for i, j in chunks(offs):
        bounds = offs[i : j + 1] - offs[i]
        words, at = word_hashes(data[offs[i] : offs[j]], bounds)
        whole = np.zeros(len(words), np.uint64)
        n = len(words) - k + 1
        if n > 0:
            for step in range(k):
                whole[:n] = whole[:n] * np.uint64(0xD6E8FEB86659FD93) + words[step : step + n]
            whole[:n] = mix(whole[:n])
        for row in range(j - i):
            a, z = at[row], at[row + 1]
            if z - a >= k:
                yield np.unique(whole[a : z - k + 1])
            elif z > a:
                h = np.uint64(z - a)
                for w in words[a:z]:
                    h = np.uint64((int(h) * 0xD6E8FEB86659FD93 + int(w)) & 0xFFFFFFFFFFFFFFFF)
                yield mix(np.array([h], np.uint64))
            else:
                yield whole[:0]
