"""Vectorised word and shingle hashing over Arrow string columns.

A word is a run of bytes other than space and 0x09-0x0D, A-Z lower-cased. The
hash of a word is a polynomial over its bytes modulo 2**64, found for all words of
a block from one running sum, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; a longer text makes a block of its own.
BLOCK_BYTES = 1 << 20

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on a fresh array."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_CODE = mix((np.arange(256, dtype=np.uint64) + _U(1)) * _BASE) | _U(1)
_powers: list[np.ndarray] = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]] if len(at) else raw[:0], at - at[0] if len(at) else np.zeros(1, np.int64)


def blocks(at: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``most`` bytes together, or one longer text."""
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(raw: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: each word's hash, first byte and end, and the n+1 offsets of each text's words."""
    n = len(raw)
    if n == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(at), np.int64)
    solid = ~_SPACE[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edges = at[1:-1]
    edges = edges[edges < n]
    first[edges] = solid[edges]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    before = edges[edges > 0] - 1
    last[before] = solid[before]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _power(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_CODE[_LOWER[raw] if lower else raw] * power, dtype=np.uint64, out=total[1:])
    hashed = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    return hashed, start, end, np.searchsorted(start, at)


def grams(hashed: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n words (over text ends too; the caller leaves those out)."""
    if len(hashed) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashed) - n + 1, np.uint64)
    for k in range(n):
        out *= _U(0xD6E8FEB86659FD93)
        out += hashed[k : len(hashed) - n + 1 + k]
    return mix(out)


def shingle_sets(column: pa.Array, n: int = 5) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingles of n words; the whole sequence if shorter; empty without words."""
    raw, at = texts(column)
    for i, j in blocks(at):
        part = at[i : j + 1] - at[i]
        hashed, _, _, of = words(raw[at[i] : at[j]], part)
        every = grams(hashed, n)
        for k in range(j - i):
            a, b = of[k], of[k + 1]
            if b - a >= n:
                yield np.unique(every[a : b - n + 1])
            elif b > a:
                yield grams(hashed[a:b], int(b - a)) ^ _U(b - a)
            else:
                yield every[:0]
