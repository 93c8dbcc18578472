"""Hashes of words and word shingles of whole texts, a batch at a time in numpy.

Words are runs of bytes other than 0x20 and 0x09 to 0x0D; A-Z count as a-z. A text with fewer than k words, but at
least one, has its whole word sequence as its only shingle. Shingles are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import slices

_BASE, _ONE = np.uint64(0x9E3779B97F4A7C15), np.uint64(1)
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (SplitMix64's finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE to the powers 0 to n - 1, and of its inverse modulo 2 to the 64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _POWERS[:] = [np.cumprod(np.concatenate([[_ONE], np.full(size - 1, b, np.uint64)])) for b in (_BASE, inverse)]
    return _POWERS[0][:n], _POWERS[1][:n]


def words(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows in order, and the places where each row's begin (n + 1)."""
    n = len(body)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = (body == 32) | ((body >= 9) & (body <= 13))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[True], space[:-1]]) | edge[:-1]
    after = np.concatenate([space[1:], [True]]) | edge[1:]
    start, stop = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    power, inverse = _powers(n)
    upper = (body >= 65) & (body <= 90)
    summed = np.concatenate([[np.uint64(0)], np.cumsum((body + np.uint8(32) * upper + np.uint64(1)) * power)])
    hashes = mix((summed[stop] - summed[start]) * inverse[start] + (stop - start).astype(np.uint64))
    return hashes, np.searchsorted(start, offsets)


def shingles(body: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The set of each row, as ascending hashes."""
    for low, high in slices(offsets):
        at = offsets[low : high + 1]
        hashes, first = words(body[at[0] : at[-1]], at - at[0])
        spread = [mix(hashes + np.uint64((j + 1) * int(_BASE) % (1 << 64))) for j in range(k)]
        m = len(hashes) - k + 1
        joined = mix(sum((s[j : j + m] * np.uint64(2 * j + 1) for j, s in enumerate(spread)), np.zeros(m, np.uint64))) if m > 0 else hashes[:0]
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= k:
                yield np.unique(joined[a : b - k + 1])
            elif b > a:
                whole = sum((spread[j][a + j : a + j + 1] * np.uint64(2 * j + 1) for j in range(b - a)), np.full(1, b - a, np.uint64))
                yield mix(whole)
            else:
                yield hashes[:0]
