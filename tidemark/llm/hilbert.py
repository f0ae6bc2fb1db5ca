"""Positions on Hilbert curves, for many points at once."""

from __future__ import annotations

import numpy as np


def curve_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert position (uint64) of points given as cells (n x axes, each below 2**bits); axes * bits is at most 64.

    Works plane by plane from the highest bit: every axis that is set reflects the
    lower bits of the first axis, every one that isn't swaps them with it; a Gray code
    over the axes of each plane then gives the position.
    """
    x = cells.astype(np.uint64).T.copy()
    axes = len(x)
    for plane in range(bits - 1, 0, -1):
        bit, below = np.uint64(1 << plane), np.uint64((1 << plane) - 1)
        for a in range(axes):
            reflect = (x[a] & bit) != 0
            swap = np.where(reflect, np.uint64(0), (x[0] ^ x[a]) & below)
            x[0] ^= np.where(reflect, below, swap)
            x[a] ^= swap
    for a in range(1, axes):
        x[a] ^= x[a - 1]
    turn = np.zeros(len(cells), np.uint64)
    for plane in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> np.uint64(plane)) & np.uint64(1) != 0, np.uint64((1 << plane) - 1), np.uint64(0))
    x ^= turn
    key = np.zeros(len(cells), np.uint64)
    for plane in range(bits - 1, -1, -1):
        for a in range(axes):
            key = (key << np.uint64(1)) | ((x[a] >> np.uint64(plane)) & np.uint64(1))
    return key
