"""Signature trees over sets of tokens, and the dual traversal that links sets by Jaccard similarity.

A node of the tree has the union (OR) of its sets' token bitmaps, the range of their sizes and the
largest number of tokens that a set lost to bitmap collisions.  Two sets under two nodes can share at
most popcount(or1 & or2) tokens and those losses, and not more than the smaller set's size; a pair of
nodes that cannot reach the overlap which the sizes ask for is left out with all that is below it.
"""

from __future__ import annotations

import numpy as np

FAN = 8


class Links:
    """Sets that are known to be connected."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)
        self.groups = n

    def join(self, a: int, b: int) -> None:
        x, y = self.label[a], self.label[b]
        if x != y:
            self.label[self.label == max(x, y)] = min(x, y)
            self.groups -= 1

    def one(self, lo: int, hi: int) -> int:
        """The group that all of lo..hi are in, or -1."""
        part = self.label[lo:hi]
        return int(part[0]) if (part == part[0]).all() else -1


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Tokens that two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


class SignatureTree:
    """Of sorted token arrays, in the order given (similar sets should be near each other)."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets = sets
        size = np.array([len(s) for s in sets])
        bits = 64
        while bits < min(1 << 14, 2 * int(size.max())):
            bits *= 2
        words = np.zeros((len(sets), bits // 8), np.uint8)
        for k, s in enumerate(sets):
            row = np.zeros(bits, bool)
            row[(s >> np.uint64(7)).astype(np.int64) & (bits - 1)] = True
            words[k] = np.packbits(row)
        bitmap = words.view(np.uint64)
        lost = size - np.bitwise_count(bitmap).sum(1).astype(np.int64)
        lo = np.arange(len(sets))
        self.levels = [(bitmap, size, size, lost, lo, lo + 1)]
        while len(self.levels[-1][0]) > 1:
            b, small, large, lost, lo, hi = self.levels[-1]
            at = np.arange(0, len(b), FAN)
            last = np.minimum(at + FAN, len(b)) - 1
            self.levels.append(
                (np.bitwise_or.reduceat(b, at), np.minimum.reduceat(small, at), np.maximum.reduceat(large, at), np.maximum.reduceat(lost, at), lo[at], hi[last])
            )

    def possible(self, level: int, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Which of the node pairs may hold a pair of sets that links."""
        b, small, large, lost, _, _ = self.levels[level]
        most = np.bitwise_count(b[i] & b[j]).sum(1).astype(np.int64) + np.minimum(lost[i], lost[j])
        most = np.minimum(most, np.minimum(large[i], large[j]))
        # 100 * overlap >= percent * (|a| + |b| - overlap)
        asked = (100 + percent) * most >= percent * (small[i] + small[j])
        sizes = (100 * large[i] >= percent * small[j]) & (100 * large[j] >= percent * small[i])
        return asked & sizes

    def link(self, percent: int, links: Links | None = None) -> Links:
        """Connect the sets a, b with 100 * |a & b| >= percent * |a | b|; pairs inside what is connected
        already are not looked at."""
        out = links or Links(len(self.sets))
        self._pair(len(self.levels) - 1, 0, 0, percent, out)
        return out

    def _pair(self, level: int, i: int, j: int, percent: int, out: Links) -> None:
        lo, hi = self.levels[level][4], self.levels[level][5]
        a = out.one(lo[i], hi[i])
        if a >= 0 and (i != j or hi[i] - lo[i] > 1) and a == out.one(lo[j], hi[j]):
            return
        if level == 0:
            if i != j:
                x, y = self.sets[i], self.sets[j]
                n = overlap(x, y)
                if 100 * n >= percent * (len(x) + len(y) - n):
                    out.join(i, j)
            return
        below = len(self.levels[level - 1][0])
        ci = np.arange(i * FAN, min((i + 1) * FAN, below))
        if i == j:
            for c in ci:  # first what is within a child: it lets whole pairs of children be skipped
                if level > 1:
                    self._pair(level - 1, c, c, percent, out)
            x, y = np.triu_indices(len(ci), 1)
            x, y = ci[x], ci[y]
        else:
            cj = np.arange(j * FAN, min((j + 1) * FAN, below))
            x, y = np.repeat(ci, len(cj)), np.tile(cj, len(ci))
        if not len(x):
            return
        keep = self.possible(level - 1, x, y, percent)
        for p, q in zip(x[keep].tolist(), y[keep].tolist()):
            self._pair(level - 1, p, q, percent, out)
