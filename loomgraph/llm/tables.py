"""Numpy tables that several operators use inside Python workers."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)


class HashIndex:
    """Open addressing over unique uint64 keys: lookup() gives each code's row, or -1."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.ascontiguousarray(keys, np.uint64)
        bits = max(4, int(2 * len(self.keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        todo = np.arange(len(self.keys), dtype=np.int32)
        at = self._slot(self.keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            lost = self.slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & self.mask
        self.held = np.zeros(1 << bits, np.uint64)
        used = self.slots >= 0
        self.held[used] = self.keys[self.slots[used]]

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * _ODD) >> self.shift).astype(np.int64)

    def lookup(self, codes: np.ndarray) -> np.ndarray:
        at = self._slot(codes)
        row = self.slots[at]
        miss = np.flatnonzero((row >= 0) & (self.held[at] != codes))
        at = at[miss]
        while len(miss):
            at = (at + 1) & self.mask
            r = self.slots[at]
            row[miss] = r
            more = (r >= 0) & (self.held[at] != codes[miss])
            miss, at = miss[more], at[more]
        return row


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for each (start, length), one after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)
