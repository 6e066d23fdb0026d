"""64-bit hashes of the words and word shingles of a text, in numpy."""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A published bijective finaliser of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _stream(seed: int, n: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


_BYTE = _stream(1, 256)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MULTIPLIER = np.uint64(0xD1342543DE82EF95)
_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            steps = np.full(2 * n, _MULTIPLIER)
            steps[0] = 1
            _powers = np.multiply.accumulate(steps)
    return _powers


def word_hashes(text: bytes) -> np.ndarray:
    """Of each run of other than ASCII white space, A-Z lower-cased."""
    raw = np.frombuffer(text, np.uint8)
    at = np.flatnonzero(~_SPACE[raw])
    if not len(at):
        return np.empty(0, np.uint64)
    begins = np.empty(len(at), bool)
    begins[0] = True
    np.greater(at[1:], at[:-1] + 1, out=begins[1:])
    first = np.flatnonzero(begins)
    sizes = np.diff(first, append=len(at))
    inside = np.arange(len(at)) - np.repeat(first, sizes)
    sums = np.add.reduceat(_BYTE_LOWER[raw[at]] * _power(int(sizes.max()))[inside], first)
    return mix(sums + sizes.astype(np.uint64))


_PLACES = _stream(2, 16) | np.uint64(1)


def shingle_set(text: bytes, k: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the k-word shingles; of the whole sequence where there are fewer words; none without words."""
    w = word_hashes(text)
    if not len(w):
        return w
    if len(w) < k:
        return mix((w * _PLACES[: len(w)]).sum(keepdims=True) + np.uint64(len(w)))
    sums = w[: len(w) - k + 1] * _PLACES[0]
    for j in range(1, k):
        sums = sums + w[j : len(w) - k + 1 + j] * _PLACES[j]
    return np.unique(mix(sums))
