"""The suffix tree of a sequence of numbers, as suffix array and LCP intervals, with all queries on whole arrays.

A node at depth d is the run of suffixes (in order) that share d numbers; the suffix link of the leaf of place p is the leaf of
p + 1. The sequence must hold separators that occur once each, at its end at least, so that no common stretch crosses one.
"""

from __future__ import annotations

import numpy as np


def expand(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers first, first + 1, .. (`count` of them) of each row, and the row each belongs to."""
    owner = np.repeat(np.arange(len(first)), count)
    return np.arange(len(owner)) - np.repeat(np.cumsum(count) - count - first, count), owner


class Suffixes:
    """order: suffixes sorted; rank: its inverse; lcp[r]: numbers that the suffixes of rank r - 1 and r share."""

    def __init__(self, numbers: np.ndarray) -> None:
        n = len(numbers)
        self.levels = [np.unique(numbers, return_inverse=True)[1].astype(np.int32)]  # level l names all stretches of 2**l numbers
        width = 1
        while int(self.levels[-1].max()) < n - 1:
            now = self.levels[-1].astype(np.int64)
            key = now * (n + 1)
            key[: n - width] += now[width:] + 1
            order = np.argsort(key)
            key = key[order]
            named = np.empty(n, np.int32)
            named[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            self.levels.append(named)
            width *= 2
        self.rank = self.levels[-1]
        self.order = np.empty(n, np.int64)
        self.order[self.rank] = np.arange(n)
        self.lcp = np.concatenate([[0], self.forward(self.order[:-1], self.order[1:])])
        self._least = [self.lcp]
        for step in (1 << np.arange(max(1, n.bit_length()))).tolist():
            below = self._least[-1]
            if len(below) <= step:
                break
            self._least.append(np.minimum(below[: len(below) - step], below[step:]))

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many numbers agree from places a and b (different ones) on."""
        out = np.zeros(len(a), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            names = self.levels[level]
            out += (names[a + out] == names[b + out]).astype(np.int64) << level
        return out

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many numbers agree up to places a and b (different ones, a < b; both included)."""
        out = np.zeros(len(a), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            names, at = self.levels[level], a - out - (1 << level) + 1
            same = (at >= 0) & (names[np.maximum(at, 0)] == names[np.maximum(at, 0) + (b - a)])
            out += same.astype(np.int64) << level
        return out

    def node(self, leaf: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last rank of the suffixes that share `depth` numbers with the one of rank `leaf`."""
        n, low, high = len(self.rank), leaf.astype(np.int64), leaf.astype(np.int64)
        for level in range(len(self._least) - 1, -1, -1):
            least, step = self._least[level], 1 << level
            at = low - step + 1
            low = low - step * ((at > 0) & (least[np.clip(at, 0, len(least) - 1)] >= depth))
            at = high + 1
            high = high + step * ((at + step <= n) & (least[np.clip(at, 0, len(least) - 1)] >= depth))
        return low, high

    def blocks(self) -> np.ndarray:
        """Where each Lempel-Ziv block starts: the longest stretch that occurs from an earlier place on, or one number."""
        n = len(self.rank)
        before, after, stack = [-1] * n, [-1] * n, []
        for p in self.order.tolist():  # nearest suffixes in order, on both sides, of an earlier place
            while stack and stack[-1] > p:
                after[stack.pop()] = p
            before[p] = stack[-1] if stack else -1
            stack.append(p)
        places, longest = np.arange(n), np.zeros(n, np.int64)
        for found in (np.array(before), np.array(after)):
            at = np.flatnonzero(found >= 0)
            longest[at] = np.maximum(longest[at], self.forward(found[at], places[at]))
        steps, out, p = np.maximum(longest, 1).tolist(), [], 0
        while p < n:
            out.append(p)
            p += steps[p]
        return np.array(out)
