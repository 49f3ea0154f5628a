"""Vectorised words and shingles: hashes of all words of a batch of texts with numpy.

A word is a maximal run of bytes other than blank and 0x09-0x0D in the UTF-8 text, with
A-Z lower-cased. Its hash is a polynomial in a random odd base over random byte values,
modulo 2^64, taken from prefix sums, then mixed with its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text handled at once; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20

_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = int(_rng.integers(1, 2**63)) * 2 + 1
_POWERS: list[np.ndarray] = []
#: Odd multipliers for the words of a shingle.
_TERMS = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values (two multiply-xorshift rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, x, np.uint64)])) for x in (_BASE, pow(_BASE, -1, 2**64))]
    return _POWERS[0][:n], _POWERS[1]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of consecutive rows with about ``limit`` bytes of text; null texts are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, last, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of each word, its hash, its first byte, its end) for the rows of a chunk."""
    n = len(data)
    if not n:
        none = np.empty(0, np.int64)
        return none, np.empty(0, np.uint64), none, none
    inside = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(end) + 1
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up, out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return np.searchsorted(offsets, starts, "right") - 1, h, starts, ends


def shingles(rows: np.ndarray, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, first word's index) of each window of k words; a row with fewer words has its whole sequence as one."""
    n = len(rows)
    if not n:
        return rows, hashes, rows
    bounds = np.flatnonzero(np.diff(rows)) + 1
    first, last = np.concatenate([[0], bounds]), np.concatenate([bounds, [n]])
    parts = []
    size = last - first
    for j in range(1, k):
        short = first[size == j]
        if len(short):
            parts.append((short, sum(hashes[short + i] * _TERMS[i] for i in range(j)) + np.uint64(j)))
    if n >= k:
        at = np.flatnonzero(rows[: n - k + 1] == rows[k - 1 :])
        h = np.full(len(at), np.uint64(k))
        for i in range(k):
            h += hashes[at + i] * _TERMS[i]
        parts.append((at, h))
    at, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(at, kind="stable")
    at = at[order]
    return rows[at], mix(h[order]), at


def distinct(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash), sorted by row and hash."""
    order = np.lexsort((hashes, rows))
    r, h = rows[order], hashes[order]
    keep = np.ones(len(r), bool)
    keep[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    return r[keep], h[keep]
