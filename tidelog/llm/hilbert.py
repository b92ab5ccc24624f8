"""Hilbert curve positions of integer points, for whole arrays."""

from __future__ import annotations

import numpy as np


def positions(points: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of ``points``.

    ``points`` has unsigned coordinates under 2**bits; at most 63 bits in all.
    The coordinates are turned to the curve's transposed index by exchanging and
    inverting low bits from the top bit down (Skilling 2004), then interleaved.
    """
    x = points.astype(np.uint64).copy()
    n, d = x.shape
    if bits * d > 63:
        raise ValueError("over 63 bits")
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        q = one << np.uint64(level)
        low = q - one
        for i in range(d):
            high = (x[:, i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(high, low, swap)
            if i:
                x[:, i] ^= swap
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(n, np.uint64)
    for level in range(bits - 1, 0, -1):
        q = one << np.uint64(level)
        flip ^= np.where((x[:, d - 1] & q) != 0, q - one, np.uint64(0))
    x ^= flip[:, None]
    key = np.zeros(n, np.uint64)
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << one | x[:, i] >> np.uint64(level) & one
    return key.astype(np.int64)
