"""SuperMinHash signatures in numpy.

Each element draws a random permutation of the m positions, one step at a time, and offers the value `step + u` to the position of each step. A position
keeps the least value offered. Ranks of one element are correlated, unlike in MinHash, which lowers the variance of
the similarity estimate. As step j offers values of j and more, a set is finished as soon as all its positions are filled:
large sets stop after their first step, and only small sets go on.
"""

from __future__ import annotations

import numpy as np

from .words import mix

_U = np.uint64
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def signatures(element: np.ndarray, edge: np.ndarray, m: int) -> np.ndarray:
    """A signature of m values for each of the sets element[edge[i]:edge[i + 1]]; sets without elements keep _EMPTY everywhere."""
    if not 1 < m <= 256:
        raise ValueError("m must be between 2 and 256")
    n = len(edge) - 1
    h = np.full((n, m), _EMPTY)
    flat = h.reshape(-1)
    owner = np.repeat(np.arange(n), np.diff(edge))
    perm = None
    for j in range(m):
        x = mix(element + _U((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        k = j + (((x & _U(0xFFFFFFFF)) * _U(m - j)) >> _U(32)).astype(np.int64)
        value = (x >> _U(32)) | _U(j << 32)
        if perm is None:
            p = k
        else:
            rows = np.arange(len(element))
            p = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[rows, j]
        np.minimum.at(flat, owner * m + p, value)
        unfilled = (h == _EMPTY).any(axis=1)
        go = unfilled[owner]
        if not go.any():
            break
        if not go.all():
            element, owner, k = element[go], owner[go], k[go]
            perm = perm[go] if perm is not None else None
        if perm is None:
            perm = np.tile(np.arange(m, dtype=np.uint8), (len(element), 1))
            perm[np.arange(len(element)), k] = 0
    return h


def bands(h: np.ndarray, rows: int) -> np.ndarray:
    """One signed 64-bit key for each run of `rows` signature values, different from band to band."""
    count = h.shape[1] // rows
    key = np.tile(np.arange(1, count + 1, dtype=np.uint64), (len(h), 1))
    for r in range(rows):
        key = mix(key * _U(0x9FB21C651E98DF25) + h[:, r : count * rows : rows])
    return key.view(np.int64)
