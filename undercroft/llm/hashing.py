"""Hashes of many spans of one byte buffer at once.

The hash of bytes is a polynomial in an odd base modulo 2**64, then mixed.  Prefix sums give every span of a buffer;
the inverse of the base takes the position out, so equal bytes hash alike wherever they stand.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (three xor-shifts, two odd factors)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Spans:
    """Hashes of spans of ``data`` (uint8)."""

    def __init__(self, data: np.ndarray) -> None:
        self.back = powers(INVERSE, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts])

    def grams(self, size: int) -> np.ndarray:
        """Of every run of ``size`` bytes."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.back[:n]) if n > 0 else np.zeros(0, np.uint64)
