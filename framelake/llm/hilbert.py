"""Hilbert keys of points with whole-number coordinates (Skilling's transposition, 2004), vectorised."""

from __future__ import annotations

import numpy as np


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """uint64 keys of points (n, d) with coordinates in [0, 2**bits); d * bits may be at most 63."""
    n, d = points.shape
    if d * bits > 63:
        raise ValueError("keys have at most 63 bits")
    x = points.astype(np.uint64).T.copy()
    one = np.uint64(1)
    q = one << np.uint64(bits - 1)
    while q > one:
        low = q - one
        for i in range(d):
            on = (x[i] & q) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        q >>= one
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros(n, np.uint64)
    q = one << np.uint64(bits - 1)
    while q > one:
        t = np.where((x[d - 1] & q) != 0, t ^ (q - one), t)
        q >>= one
    x ^= t
    key = np.zeros(n, np.uint64)
    for bit in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << one) | ((x[i] >> np.uint64(bit)) & one)
    return key
