"""Sorted sets of hashes in few bits, dealt by ranges, so that chunks learn which of their hashes others have.

A set of n numbers below 2^u takes about u - log2(n) + 2 bits a number (Elias-Fano): the upper bits as a row of marks,
the lower ones as they are.
"""

from __future__ import annotations

import numpy as np


def _low(n: int, width: int) -> int:
    return max(0, width - max(0, n - 1).bit_length())


def pack(values: np.ndarray, width: int) -> bytes:
    """Sorted distinct numbers below 2^width."""
    n = len(values)
    if not n:
        return b""
    low = _low(n, width)
    octets = values.astype("<u8").view(np.uint8).reshape(n, 8)
    lower = np.packbits(np.unpackbits(octets, axis=1, count=low, bitorder="little"), bitorder="little") if low else octets[:0]
    at = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    marks = np.zeros(int(at[-1]) + 1, np.uint8)
    marks[at] = 1
    return lower.tobytes() + np.packbits(marks, bitorder="little").tobytes()


def unpack(packed: bytes, n: int, width: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    low = _low(n, width)
    data = np.frombuffer(packed, np.uint8)
    size = -(-n * low // 8)
    out = ((np.flatnonzero(np.unpackbits(data[size:], bitorder="little")) - np.arange(n)).astype(np.uint64)) << np.uint64(low)
    if low:
        octets = np.packbits(np.unpackbits(data[:size], count=n * low, bitorder="little").reshape(n, low), axis=1, bitorder="little")
        full = np.zeros((n, 8), np.uint8)
        full[:, : octets.shape[1]] = octets
        out |= full.view("<u8")[:, 0]
    return out


def pack_marks(marks: np.ndarray) -> bytes:
    return np.packbits(marks, bitorder="little").tobytes()


def unpack_marks(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=n, bitorder="little").astype(bool)


def edges(values: np.ndarray, width: int, bits: int) -> np.ndarray:
    """Where the ranges of sorted numbers below 2^width begin that agree in their first ``bits`` bits; the end as well."""
    return np.append(np.searchsorted(values, np.arange(1 << bits, dtype=np.uint64) << np.uint64(width - bits)), len(values))


def tops(values: np.ndarray, width: int) -> np.ndarray:
    """The distinct first ``width`` bits of sorted hashes."""
    out = values >> np.uint64(64 - width)
    return out[first_of(out)]


def first_of(values: np.ndarray) -> np.ndarray:
    """Whether a value of a sorted array is the first of its kind."""
    out = np.ones(len(values), bool)
    out[1:] = values[1:] != values[:-1]
    return out


def repeated(values: np.ndarray) -> np.ndarray:
    """Whether each value occurs again."""
    order = np.sort(values)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return np.zeros(len(values), bool)
    return again[np.minimum(np.searchsorted(again, values), len(again) - 1)] == values


def totals(values: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """For each value the sum of the numbers of all that equal it."""
    if not len(values):
        return numbers
    by = np.argsort(values)
    first = first_of(values[by])
    sums = np.add.reduceat(numbers[by], np.flatnonzero(first))
    out = np.empty_like(numbers)
    out[by] = sums[np.cumsum(first) - 1]
    return out
