"""SuperMinHash signatures of many sets at once.

An element e draws, step by step, a random number and a place of a random permutation of the signature (Fisher-Yates);
step j offers j + random at that place, and a place keeps the least offer. Since an element visits every place once, its
ranks are correlated and the signature varies less than with independent hashes; once every place holds an offer of step
j or before, no later step can change a set's signature, and the set stops early. All elements of all sets take a step
together; the sets that still have empty places take the next.
"""

from __future__ import annotations

import numpy as np

from evalfold.llm.words import mix

_STEP = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: A signature's value is the step above RANDOM_BITS bits of the random number.
RANDOM_BITS = 40


def signatures(elements: np.ndarray, sizes: np.ndarray, m: int) -> np.ndarray:
    """One row of `m` values for each set; `elements` holds the sets one after another, distinct within a set.

    m: at most 256. An empty set's row is all ones.
    """
    n = len(sizes)
    flat = np.full(n * m, _EMPTY, dtype=np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    hashes = elements.astype(np.uint64)
    drawn: list[np.ndarray] = []  # of each step, the slot that each element swapped with
    open_ = sizes > 0
    for j in range(m):
        live = open_[owner]
        if not live.any():
            break
        if live.mean() < 0.7:
            owner, hashes, drawn = owner[live], hashes[live], [d[live] for d in drawn]
        random = mix(hashes + np.uint64((j + 1) * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
        slot = (j + (random & np.uint64(0xFFFFFF)) % np.uint64(m - j)).astype(np.int16)
        # What the permutation holds at that slot: slots below j were swapped into the slot that their step drew.
        place = slot.copy()
        for i in range(j - 1, -1, -1):
            place[place == drawn[i]] = i
        drawn.append(slot)
        offer = (np.uint64(j) << np.uint64(RANDOM_BITS)) | (random >> np.uint64(64 - RANDOM_BITS))
        np.minimum.at(flat, owner * m + place, offer)
        open_ = open_ & (flat.reshape(n, m) == _EMPTY).any(axis=1)
    return flat.reshape(n, m)


def band_hashes(rows: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit hash of each band of each signature; equal bands of different numbers have different hashes."""
    n, m = rows.shape
    width = m // bands
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)).copy()
    for i in range(width):
        h = mix(h * _STEP + rows[:, i : bands * width : width])
    return h
