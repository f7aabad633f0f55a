"""Vectorised 64-bit hashes of byte ranges, by prefix sums.

The hash of ``data[s:e]`` is the sum of ``(byte + 1) * B**(i - s)`` modulo
2**64, taken from one running sum, then mixed; equal ranges have equal hashes
wherever they stand.
"""

from __future__ import annotations

import numpy as np

B = 0x9E3779B97F4A7C15 | 1
B_INVERSE = pow(B, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(factor: int, n: int) -> np.ndarray:
    held = _POWERS.get(str(factor))
    if held is None or len(held) < n:
        out = np.full(max(n, 1 << 16), np.uint64(factor & (2**64 - 1)))
        out[0] = 1
        held = np.multiply.accumulate(out)
        if len(held) <= 16 << 20:
            _POWERS[str(factor)] = held
    return held[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def running(data: np.ndarray) -> np.ndarray:
    """The running sum, from 0, of ``(byte + 1) * B**i``."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(B, len(data)), out=out[1:])
    return out


def of_ranges(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * _powers(B_INVERSE, len(sums))[starts])
