"""Minimal perfect hashing of distinct 128-bit digests, in numpy."""

from __future__ import annotations

import numpy as np

from emberlog.llm.common import mix, seeds

LEVELS = 64
_SEEDS = seeds(LEVELS, 51 << 40)


def _places(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(mix(high + _SEEDS[level]) + low) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Slots 0 … n-1 for n distinct digests (two 64-bit halves), verified at every look-up.

    Every level hashes the digests that are left to twice as many bits; those that are alone on their
    bit stay there, the others go on. A digest's slot is the number of set bits before its own.
    """

    def __init__(self, high: np.ndarray, low: np.ndarray) -> None:
        self.sizes: list[int] = []
        bits: list[np.ndarray] = []
        left = np.arange(len(high))
        while len(left):
            if len(bits) == LEVELS:
                raise ValueError("digests aren't distinct")
            size = 2 * len(left)
            at = _places(high[left], low[left], len(bits), size)
            alone = np.bincount(at, minlength=size) == 1
            self.sizes.append(size)
            bits.append(alone)
            left = left[~alone[at]]
        self.bits = np.concatenate(bits) if bits else np.zeros(0, dtype=bool)
        self.rank = np.cumsum(self.bits) - 1
        self.high = np.zeros(len(high), dtype=np.uint64)
        self.low = np.zeros(len(high), dtype=np.uint64)
        slots = self._slots(high, low)
        self.high[slots], self.low[slots] = high, low

    def _slots(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        out = np.full(len(high), -1, dtype=np.int64)
        left, base = np.arange(len(high)), 0
        for level, size in enumerate(self.sizes):
            at = base + _places(high[left], low[left], level, size)
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left = left[~hit]
            base += size
        return out

    def find(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Slot of every digest, or -1 if the table doesn't hold it: the digest in the slot decides."""
        slots = self._slots(high, low)
        if len(self.high):
            other = (self.high[slots] != high) | (self.low[slots] != low)
            slots[other] = -1
        return slots
