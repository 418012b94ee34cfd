"""SuperMinHash signatures of shingle sets.

Every element draws, from its own hash, a random permutation of the signature's places and a uniform number for each; place p takes
the least of (rank of p in the element's permutation + uniform number). The ranks of one element are correlated (each place gets a rank of its own), which
lowers the variance against independent minima, and no later rank can change a signature whose largest value is below it, so most
sets stop after a few ranks. Many sets are advanced together, one rank at a time.
"""

from __future__ import annotations

import numpy as np

from .words import U64, mix

#: Fraction bits of a signature value; the rank stands above them. Elements that are advanced together.
FRACTION, TOGETHER = 25, 1 << 14
GOLDEN = 0x9E3779B97F4A7C15
EMPTY = np.uint32(0xFFFFFFFF)


def signatures(hashes: np.ndarray, first: np.ndarray, size: int = 128) -> np.ndarray:
    """One row of ``size`` (at most 128) uint32 for each set hashes[first[i]:first[i+1]]; an empty set gives EMPTY throughout."""
    n = len(first) - 1
    out = np.full((n, size), EMPTY, np.uint32)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + TOGETHER, side="right")) - 1)
        for a in range(int(first[lo]), int(first[hi]), TOGETHER):  # more than one turn only for a single large set
            b = min(a + TOGETHER, int(first[hi])) if hi == lo + 1 else int(first[hi])
            sets = np.repeat(np.arange(hi - lo), np.diff(np.clip(first[lo:hi + 1], a, b)))
            _advance(hashes[a:b], sets, out[lo:hi])
            if b == first[hi]:
                break
        lo = hi
    return out


def _advance(hashes: np.ndarray, sets: np.ndarray, out: np.ndarray) -> None:
    size = out.shape[1]
    flat, order = out.reshape(-1), None
    for rank in range(size):
        if rank:
            open_ = (out.max(axis=1) >> FRACTION) >= rank
            keep = open_[sets]
            if not keep.all():
                hashes, sets = hashes[keep], sets[keep]
                order = order[keep] if order is not None else None
                drawn = drawn[keep]
            if len(sets) == 0:
                return
        x = mix(hashes + U64((GOLDEN * (rank + 1)) & (2**64 - 1)))
        value = (x & U64((1 << FRACTION) - 1)).astype(np.uint32) | np.uint32(rank << FRACTION)
        place = rank + (((x >> U64(32)) * U64(size - rank)) >> U64(32)).astype(np.int64)
        if rank == 0:
            drawn = place
        else:
            rows = np.arange(len(sets))
            if order is None:  # the first swap is made only for sets that go on
                order = np.tile(np.arange(size, dtype=np.uint8), (len(sets), 1))
                order[rows, drawn], order[:, 0] = 0, drawn
            taken = order[rows, place]
            order[rows, place] = order[:, rank]
            order[:, rank] = taken
            place = taken.astype(np.int64)
        np.minimum.at(flat, sets * size + place, value)


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """int64 key of each band of ``rows`` values, distinct between bands."""
    n, size = signature.shape
    bands = size // rows
    parts = signature[:, :bands * rows].reshape(n, bands, rows).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * U64(GOLDEN)
    for i in range(rows):
        key = mix(key ^ (parts[:, :, i] + U64((i + 1) * 0xD6E8FEB86659FD93 & (2**64 - 1))))
    return key.view(np.int64)
