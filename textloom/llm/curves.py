"""Hilbert keys of points, vectorised."""

from __future__ import annotations

import numpy as np


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each cell along the Hilbert curve.

    ``cells``: rows of coordinates from 0 to 2**bits - 1; coordinates times bits must be 63 at
    most.  Gray-code form: each axis in turn, from the highest bit down, either turns over the
    lower bits of the first axis or swaps them with its own.
    """
    x = cells.astype(np.uint64).T.copy()
    dims = len(x)
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        high = one << np.uint64(level)
        low = high - one
        for axis in range(dims):
            flip = (x[axis] & high) != 0
            swap = np.where(flip, np.uint64(0), (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[axis] ^= swap
    for axis in range(1, dims):
        x[axis] ^= x[axis - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        high = one << np.uint64(level)
        turn ^= np.where((x[dims - 1] & high) != 0, high - one, np.uint64(0))
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in range(dims):
            key = (key << one) | ((x[axis] >> np.uint64(level)) & one)
    return key.astype(np.int64)
