"""Hashes of the words of many texts at once, without an object for each word.

A word's hash is a polynomial over random 64-bit values of its bytes, read off running sums over a block of bytes, so
the work is a few array operations a byte.
"""

from __future__ import annotations

import functools

import numpy as np

#: Bytes in a block of running sums; longer words are hashed alone.
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of bytes, and powers of the base and of its inverse."""
    values = np.random.default_rng(20_240_607).integers(0, 1 << 64, 256, np.uint64)

    def powers(b: int) -> np.ndarray:
        out = np.full(2 * BLOCK + 1, b, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return values, powers(_BASE), powers(pow(_BASE, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (separated by ASCII white space) in order, and the number of words of each text."""
    joined = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    space = _SPACE[joined]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edge[::2], edge[1::2]
    if len(ends) < len(starts):
        ends = np.append(ends, len(joined))
    offsets = np.cumsum([0, *[len(t) + 1 for t in texts]])
    sizes = np.diff(np.searchsorted(starts, offsets))
    values, powers, inverse = _tables()
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, side="right")))
        a, b = int(starts[i]), int(ends[j - 1])
        if b - a > BLOCK:  # one long word
            h, power = np.uint64(0), np.uint64(1)
            for k in range(a, b, BLOCK):
                part = joined[k : min(b, k + BLOCK)]
                with np.errstate(over="ignore"):
                    h = h + (values[part] * powers[: len(part)]).sum(dtype=np.uint64) * power
                    power = power * powers[BLOCK]
            out[i] = h
        else:
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum(values[joined[a:b]] * powers[: b - a], dtype=np.uint64, out=sums[1:])
            s, e = starts[i:j] - a, ends[i:j] - a
            out[i:j] = (sums[e] - sums[s]) * inverse[s]
        i = j
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), sizes


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n values from each place on, composed of runs of powers of two."""
    size = len(h) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out, power, done, step, factor = None, h, 0, 1, _BASE
    while step <= n:
        if n & step:
            part = power[done : done + size]
            out = part if out is None else out * np.uint64(factor) + part
            done += step
        if step * 2 <= n:
            power = power[:-step] * np.uint64(factor) + power[step:]
            factor = factor * factor % (1 << 64)
        step *= 2
    return mix(out)
