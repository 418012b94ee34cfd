"""Words of whole texts and their 64-bit hashes, computed on Arrow buffers without a Python object per word.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd, so it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C55 | 1
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes hashed at a time; a longer word is hashed by itself.
CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


VALUES = mix(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1)
        have = np.full(size, base % (1 << 64), dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


def forget_powers() -> None:
    """They take milliseconds to make again, and megabytes to keep."""
    _powers.clear()


def rolling(values: np.ndarray, window: int, base: int = BASE) -> np.ndarray:
    """Rabin-Karp hash of every run of ``window`` values: sum of values[s+i] * base**(window-1-i) modulo 2**64, by prefix sums."""
    n = len(values)
    if n < window:
        return np.empty(0, np.uint64)
    inverse = pow(base, -1, 1 << 64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(inverse, n), out=sums[1:])
    return (sums[window:] - sums[:-window]) * powers(base, n + window)[window - 1:n]


class Words(NamedTuple):
    starts: np.ndarray  #: byte positions
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  #: index of each document's first word, and at the end the number of words


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    if len(offsets) == 0:
        offsets = np.zeros(1, np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(data, np.uint8)[lo:hi] if data is not None and hi > lo else np.empty(0, np.uint8)
    return data, offsets - lo


def split_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words of the documents that lie end to end in data."""
    if len(data) == 0:
        none = np.empty(0, np.int64)
        return Words(none, none, np.empty(0, np.uint64), np.zeros(len(offsets), np.int64))
    if lower:
        data = LOWER[data]
    word = ~SPACE[data]
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    full = offsets[1:] > offsets[:-1]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    begin[heads] = word[heads]
    end[tails] = word[tails]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    hashes = np.empty(len(starts), np.uint64)
    inverse = pow(BASE, -1, 1 << 64)
    at = 0
    while at < len(starts):
        lo = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, lo + CHUNK, side="right")))
        hi = ends[stop - 1]
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(VALUES[data[lo:hi]] * powers(BASE, hi - lo), out=sums[1:])
        s, e = starts[at:stop] - lo, ends[at:stop] - lo
        hashes[at:stop] = (sums[e] - sums[s]) * powers(inverse, hi - lo)[s] + (e - s).astype(np.uint64) * U64(0xD6E8FEB86659FD93)
        at = stop
    return Words(starts, ends, mix(hashes), np.searchsorted(starts, offsets))
