"""Words of many texts at once: where they lie and a hash of each."""

from __future__ import annotations

import numpy as np

from strideframe.llm.bytewise import prefix_sums, substrings

#: Bytes with A-Z in lower case.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Bytes of words between white space, and of terms: ASCII letters and digits, and every other character.
SPACED = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])
TERMS = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])


def runs(data: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and row of each maximal run of bytes ``inside``; no run crosses from a text to the next."""
    inner = inside[data]
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, none
    edge = np.zeros(len(data) + 1, bool)  # between which bytes a text ends
    edge[ends] = edge[0] = True
    begins, stops = inner.copy(), inner.copy()
    begins[1:] &= ~inner[:-1] | edge[1:-1]
    stops[:-1] &= ~inner[1:] | edge[1:-1]
    first = np.flatnonzero(begins)
    return first, np.flatnonzero(stops) + 1, np.searchsorted(ends, first, side="right")


def hashed(data: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end, row and hash of each run of lower-cased bytes."""
    first, stop, row = runs(data, ends, inside)
    return first, stop, row, substrings(prefix_sums(LOWER[data]), first, stop)
