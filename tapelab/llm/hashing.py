"""Hash tables and rolling hashes in numpy."""

from __future__ import annotations

import numpy as np

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # the golden ratio's fraction of 2**64


class HashTable:
    """uint64 keys to int32 values; open addressing with linear probes, built and looked up in whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        keys = keys.astype(np.uint64)
        bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.values[at] < 0
            _, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[at[won]], self.values[at[won]] = keys[left[won]], values[left[won]]
            stay = np.ones(len(left), bool)
            stay[won] = False
            left, at = left[stay], (at[stay] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * MULTIPLIER) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of ``keys``; -1 where there is none."""
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.values[at], -1)
        left = np.flatnonzero((self.keys[at] != keys) & (self.values[at] >= 0))
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            hit, filled = self.keys[at] == keys[left], self.values[at] >= 0
            out[left[hit & filled]] = self.values[at[hit & filled]]
            more = ~hit & filled
            left, at = left[more], at[more]
        return out
