"""The words of many texts at once, found and hashed with numpy over a run of UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def word_bytes(holds: Callable[[int], bool]) -> np.ndarray:
    """Of each byte, whether it belongs to a word."""
    return np.array([holds(c) for c in range(256)])


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of `h` moves every bit of the result."""
    h = (h ^ (h >> np.uint64(32))) * _A
    h = (h ^ (h >> np.uint64(29))) * _B
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of a run of texts: lower-cased bytes (A-Z only), each word's start and end, each text's first word.

    data: the texts' bytes; offsets: where each text starts, and the end; table: of each byte, whether it belongs to a word
    (or, as numbers, to which kind of word: a word is then a run of bytes of one kind, and kind 0 is in none).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> None:
        self.data = np.concatenate([_LOWER[data], np.zeros(8, np.uint8)])
        kind = table[data]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        start, end = kind != 0, kind != 0
        if len(data):
            change = kind[1:] != kind[:-1]
            start[1:] &= change
            end[:-1] &= change
            start[inner], end[inner - 1] = kind[inner] != 0, kind[inner - 1] != 0
        self.starts = np.flatnonzero(start)
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self._eight = np.ndarray(shape=(len(self.data) - 7,), dtype="<u8", buffer=self.data, strides=(1,))

    def hashes(self, at: np.ndarray) -> np.ndarray:
        """64-bit hashes of the words with these numbers, over all their bytes."""
        start, left = self.starts[at], self.ends[at] - self.starts[at]
        h = mix(left.astype(np.uint64) * _C + (self._eight[start] & _MASKS[np.minimum(left, 8)]))
        step, rest = 8, np.flatnonzero(left > 8)
        while len(rest):
            h[rest] = mix(h[rest] * _C + (self._eight[start[rest] + step] & _MASKS[np.minimum(left[rest] - step, 8)]))
            step += 8
            rest = rest[left[rest] > step]
        return h

    def span(self, first: int, last: int) -> bytes:
        """The words from number `first` to `last` with single spaces between."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[first : last + 1], self.ends[first : last + 1]))

    def span_hashes(self, last: np.ndarray, m: int) -> np.ndarray:
        """64-bit hashes of the m words that end at each of these numbers."""
        h = np.full(len(last), m, dtype=np.uint64)
        for j in range(m - 1, -1, -1):
            h = mix(h * _C + self.hashes(last - j))
        return h
