"""Hashes of substrings of many texts at once, from prefix sums over their bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PRIME = 0x100000001B3
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes worked on at once.
AT_ONCE = 1 << 19


def powers(n: int, prime: int = PRIME, held: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006  shared by all calls in a process
    """Powers of an odd number and of its inverse, modulo 2^64."""
    n = max(1, n)
    if len(held.get(prime, ((), ()))[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        held[prime] = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, x, np.uint64)])) for x in (prime, pow(prime, -1, 1 << 64)))
    return held[prime]


def prefix_sums(data: np.ndarray, prime: int = PRIME) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data), prime)[0][: len(data)], out=total[1:])
    return total


def substrings(total: np.ndarray, first: np.ndarray, last: np.ndarray, prime: int = PRIME) -> np.ndarray:
    """Hash of the bytes from each ``first`` to each ``last``, the end excluded."""
    return mix((total[last] - total[first]) * powers(len(total), prime)[1][first])


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * ODD
    return h ^ (h >> np.uint64(32))


def chunks(batch: pa.RecordBatch, column: int):
    """(first row, bytes, ends) of runs of rows with a bounded number of bytes together; nulls are empty."""
    array = batch.column(column)
    if array.null_count:
        array = array.fill_null("")
    offsets = np.frombuffer(array.buffers()[1], np.int32, len(array) + 1, array.offset * 4).astype(np.int64)
    raw = array.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    start = 0
    while start < len(array):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + AT_ONCE, side="right")) - 1)
        yield start, data[offsets[start] : offsets[end]], offsets[start + 1 : end + 1] - offsets[start]
        start = end


