"""Hashes of any substring of an array of bytes or code points, from one running sum."""

from __future__ import annotations

import numpy as np

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, at least `size`; the longest so far are kept."""
    if which in _tables and len(_tables[which][0]) > size:
        return _tables[which]
    base = _BASES[which]
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(size + 1, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    _tables[which] = (out[0], out[1])
    return _tables[which]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the entropy of the high bits, which a polynomial modulo 2^64 favours, over all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Rolling:
    """`codes` once summed up; `of(a, b)` are the unmixed hashes of codes[a:b] for arrays a, b."""

    def __init__(self, codes: np.ndarray, which: int = 0):
        size = 1 << max(12, int(len(codes)).bit_length())
        self.powers, self.inverse = _powers(which, size)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * self.powers[: len(codes)], out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * self.inverse[a]

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all substrings of length k."""
        return (self.sums[k:] - self.sums[:-k]) * self.inverse[: len(self.sums) - k]
