"""Byte n-gram models with backoff, scored for several classes at a time.

A model is a table for each gram length m: the gram as a number, and for each
class `cost`, the bits its last byte takes after its first m - 1 in full, and
`leave`, the bits it takes to leave the gram as a context for the next shorter
one. Both are worked out once, when the model is made; scoring looks up the
longest known gram that ends at a position and adds what the contexts passed
over cost to leave.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np

from .tables import HashIndex


def codes(stream: np.ndarray, longest: int) -> list[np.ndarray]:
    """codes[m][i]: the m bytes of stream that end at i as a number (m from 0)."""
    out = [np.zeros(len(stream), np.uint64)]
    wide = stream.astype(np.uint64)
    for m in range(1, longest + 1):
        c = out[-1].copy()
        c[m - 1 :] |= wide[: len(stream) - m + 1] << np.uint64(8 * (m - 1))
        out.append(c)
    return out


class Backoff:
    """grams[m], cost[m], leave[m] for m = 1..longest; floor: bits of a byte that no table has."""

    def __init__(self, grams, cost, leave, floor):
        self.grams, self.cost, self.leave, self.floor = grams, cost, leave, floor
        self.longest = len(grams) - 1

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "index"}

    @cached_property
    def index(self) -> list:
        return [None, *(HashIndex(g) for g in self.grams[1:])]

    def score(self, stream: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bits of the bytes of stream at these positions (each with longest - 1 bytes before it), a column a class."""
        code = codes(stream, self.longest)
        bits = np.zeros((len(at), len(self.floor)), np.float32)
        todo = np.arange(len(at))
        for m in range(self.longest, 0, -1):
            place = at[todo]
            row = self.index[m].lookup(code[m][place])
            hit = row >= 0
            bits[todo[hit]] += self.cost[m][row[hit]]
            todo = todo[~hit]
            if m == 1:
                break
            row = self.index[m - 1].lookup(code[m - 1][at[todo] - 1])
            known = row >= 0
            bits[todo[known]] += self.leave[m - 1][row[known]]
        bits[todo] += self.floor
        return bits


def _group(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unique keys, and the sums of their rows of values."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    return k[first], np.add.reduceat(values[order], first, axis=0) if len(k) else values


def _low(m: int) -> np.uint64:
    return np.uint64((1 << (8 * m)) - 1)


def build(counts: dict[int, tuple[np.ndarray, np.ndarray]], hit, leave) -> Backoff:
    """counts[m]: grams of length m and their counts, a column a class.

    hit(count, n, q, lower): bits of a gram with this count, where its context was seen n times with
    q different next bytes; lower: bits under the shorter context. leave(n, q): bits to leave a context.
    """
    longest = max(counts)
    grams, have = {}, {}
    for m in range(longest, 0, -1):
        g, c = counts[m]
        if m < longest:  # all contexts and suffixes of longer grams have a row
            more = np.concatenate([grams[m + 1] >> np.uint64(8), grams[m + 1] & _low(m)])
            g, c = _group(np.concatenate([g, more]), np.concatenate([c, np.zeros((len(more), c.shape[1]), c.dtype)]))
        else:
            g, c = _group(g, c)
        grams[m], have[m] = g, c
    n_class = have[1].shape[1]
    cost, out = {}, {}
    total, kinds = have[1].sum(0).astype(float), (have[1] > 0).sum(0).astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        empty = np.where(total > 0, leave(total, kinds), 0.0)
        floor = empty + 8.0
        cost[1] = np.where(have[1] > 0, hit(have[1], total, kinds, np.full(have[1].shape, 8.0)), floor)
        for m in range(2, longest + 1):
            up = np.searchsorted(grams[m - 1], grams[m] >> np.uint64(8))
            n, q = np.zeros((len(grams[m - 1]), n_class)), np.zeros((len(grams[m - 1]), n_class))
            np.add.at(n, up, have[m])
            np.add.at(q, up, have[m] > 0)
            out[m - 1] = np.where(n > 0, leave(n, q), 0.0)
            lower = cost[m - 1][np.searchsorted(grams[m - 1], grams[m] & _low(m - 1))]
            cost[m] = np.where(have[m] > 0, hit(have[m], n[up], q[up], lower), out[m - 1][up] + lower)
    out[longest] = np.zeros_like(cost[longest])
    pick = lambda d: [None, *(d[m].astype(np.float32) for m in range(1, longest + 1))]
    return Backoff([None, *(grams[m] for m in range(1, longest + 1))], pick(cost), pick(out), floor.astype(np.float32))


def ppm(counts: dict[int, tuple[np.ndarray, np.ndarray]]) -> Backoff:
    """Prediction by partial matching with escape method C: counts of all lengths."""
    return build(counts, lambda c, n, q, lower: -np.log2(c / (n + q)), lambda n, q: -np.log2(q / (n + q)))


def kneser_ney(counts: dict[int, tuple[np.ndarray, np.ndarray]], discount: float = 0.75) -> Backoff:
    """Interpolated Kneser-Ney: counts of the longest grams, continuation counts of the shorter."""

    def hit(c, n, q, lower):
        return -np.log2((c - discount) / n + discount * q / n * np.exp2(-lower))

    return build(counts, hit, lambda n, q: -np.log2(discount * q / n))


def continuations(grams: np.ndarray, counts: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """From grams of length m + 1: those of length m, with the number of different bytes before them."""
    return _group(grams & _low(m), (counts > 0).astype(np.int64))
