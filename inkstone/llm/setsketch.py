"""SetSketch: mergeable, locality-sensitive registers of exponentially spaced truncated minima.

For every element the m registers get one value each, the j-th drawn from the j-th
of m intervals of equal probability of an exponential distribution, in an order
given by the element.  A register keeps the minimum x and stores
``floor(1 - log_b(x))``, truncated to 0..q+1.  The sketch of a union is the
register-wise maximum of the sketches.
"""

from __future__ import annotations

import numpy as np

from .textkernel import U64, mix

M, BASE, RATE, LIMIT = 128, 1.001, 20.0, (1 << 16) - 2


def registers(values: np.ndarray, edges: np.ndarray, m: int = M) -> np.ndarray:
    """uint16[n_rows, m] for the 64-bit element hashes of each row (edges: row offsets).

    Intervals are taken in rising order, so a row whose registers are all filled
    after level j is done: later values are larger.  Rows without elements get 0.
    """
    n_rows = len(edges) - 1
    rows = np.repeat(np.arange(n_rows), np.diff(edges))
    low = np.full(n_rows * m, 1.0)
    shift = mix(values ^ U64(0xA5A5A5A5A5A5A5A5))
    stride = (shift >> U64(32)) | U64(1)
    for level in range(m):
        if not len(values):
            break
        u = (mix(values + U64((level + 1) * 0xD1342543DE82EF95 & (1 << 64) - 1)) >> U64(11)).astype(np.float64) * 2.0**-53
        register = ((shift + U64(level) * stride) & U64(m - 1)).astype(np.int64)
        np.minimum.at(low, rows * m + register, (level + u) / m)
        open_rows = (low.reshape(n_rows, m) >= 1.0).any(axis=1)
        keep = open_rows[rows]
        if not keep.all():
            values, rows, shift, stride = values[keep], rows[keep], shift[keep], stride[keep]
    low = low.reshape(n_rows, m)
    with np.errstate(divide="ignore"):
        level = np.floor(1.0 - np.log(-np.log1p(-np.minimum(low, 1 - 2.0**-53)) / RATE) / np.log(BASE))
    out = np.clip(level, 0, LIMIT + 1).astype(np.uint16)
    out[np.diff(edges) == 0] = 0
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(a, b)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def jaccard(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from the joint register order, row by row.

    a, b: uint16[n, m]; n_a, n_b: the sets' sizes.  The log-likelihood of the counts of
    greater, smaller and equal registers is concave in J and is searched by thirds.
    """
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - above - below
    total = np.maximum(n_a + n_b, 1).astype(float)
    u, v = n_a / total, n_b / total
    low, high = np.zeros(len(a)), np.minimum(u, v) / np.maximum(np.maximum(u, v), 1e-300)

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = _p(u - v * j), _p(v - u * j)
        tiny = 1e-300
        return above * np.log(up + tiny) + below * np.log(down + tiny) + same * np.log(np.maximum(1 - up - down, 0) + tiny)

    for _ in range(40):
        third = (high - low) / 3
        left, right = low + third, high - third
        better = likelihood(left) < likelihood(right)
        low, high = np.where(better, left, low), np.where(better, high, right)
    return (low + high) / 2


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """int64[n, m // rows]: a key for each band of register values; the band's number is part of it."""
    n, m = sketch.shape
    bands = m // rows
    keys = np.zeros((n, bands), U64)
    for j in range(rows):
        keys = mix(keys * U64(0xD6E8FEB86659FD93) + sketch[:, j : bands * rows : rows].astype(U64) + U64(1))
    return mix(keys + np.arange(1, bands + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)).view(np.int64)
