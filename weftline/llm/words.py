"""Words of whole texts as 64-bit hashes, a block of documents at a time, in numpy.

The bytes of a block are looked at together: a word's hash is a difference of running sums of ``T[byte] * P**position``,
shifted back by the inverse power, so that equal words get equal hashes wherever they stand. Different words get the
same hash with a chance of about 2**-64 for a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_P = 0x9E3779B97F4A7C15
_T = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)
BLOCK = 1 << 18


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every bit of ``x`` changes every bit of the result."""
    x = x + np.uint64((seed * 0xD1B54A32D192ED03 + 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**0.. and its inverses modulo 2**64, at least ``n`` of each."""
    global _powers
    if len(_powers[0]) < n:
        n = max(n, BLOCK + 1)
        up, down = (np.full(n, p, np.uint64) for p in (_P, pow(_P, -1, 2**64)))
        up[0] = down[0] = 1
        _powers = np.cumprod(up), np.cumprod(down)
    return _powers


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string column and the place where each text begins, with the end; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and len(column) else np.zeros(0, np.uint8)), at


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, places) of runs of whole texts of about BLOCK bytes; longer texts stand alone."""
    if not len(column):
        return
    data, at = raw(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + BLOCK, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def hashed(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of a block, and the number of the first word of each text, with the end."""
    n = len(data)
    word = np.zeros(n + 1, bool)
    np.logical_not(SPACE[data], out=word[:n])
    begins = at[:-1][at[:-1] < n]
    first = word[:n].copy()
    first[1:] &= ~word[: max(n - 1, 0)]
    first[begins] = word[begins]
    starts = np.flatnonzero(first)
    last = word[:n].copy()
    last &= ~word[1:]
    tails = at[1:][at[1:] > 0] - 1
    last[tails] = word[tails]
    ends = np.flatnonzero(last) + 1
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_T[data] * up[:n], out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * down[starts])
    return h, starts, ends, np.searchsorted(starts, at)
