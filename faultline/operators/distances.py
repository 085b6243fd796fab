"""Distances in NumPy and in Spark expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_matrix(s: pd.Series) -> np.ndarray:
    if len(s) == 0:
        return np.zeros((0, 0))
    return np.stack([np.asarray(v, dtype=np.float64) for v in s.to_numpy()])


def sq_dists(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances (exact difference form, no cancellation)."""
    out = np.empty((a.shape[0], b.shape[0]))
    step = max(1, 4_000_000 // max(1, b.shape[0] * max(1, a.shape[1])))
    for s in range(0, a.shape[0], step):
        d = a[s:s + step, None, :] - b[None, :, :]
        out[s:s + step] = np.einsum("ijk,ijk->ij", d, d)
    return out


def dists(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(sq_dists(a, b))


#: Share of the squared lengths below which a squared distance is taken from the difference.
CLOSE = 1e-6


def block_dists(a: np.ndarray, b: np.ndarray, room: np.ndarray | None = None) -> np.ndarray:
    """Euclidean distances of two blocks by one matrix product about the mean of ``b``; those so
    small that the product would lose digits are measured by the difference. ``room``: a flat
    array that may hold the result."""
    if not (np.isfinite(a).all() and np.isfinite(b).all()):
        return dists(a, b)
    center = b.mean(axis=0)
    x, y = a - center, b - center
    xx, yy = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    least = CLOSE * (xx.max() + yy.max())
    if not np.isfinite(least):
        return dists(a, b)
    room = None if room is None else room[:len(a) * len(b)].reshape(len(a), len(b))
    d = np.matmul(np.column_stack([x, xx, np.ones(len(x))]), np.column_stack([-2 * y, np.ones(len(y)), yy]).T, out=room)
    if d.size and d.min() > least:
        return np.sqrt(d, out=d)
    at = np.flatnonzero(d.ravel() <= least)
    if len(at) > d.size // 8:
        return dists(a, b)
    i, j = np.divmod(at, len(b))
    near = a[i] - b[j]
    d.ravel()[at] = np.einsum("ij,ij->i", near, near)
    return np.sqrt(d, out=d)


#: Rounding of a squared distance by products, as a share of the squared lengths and for each entry.
ROUNDING = 1e-14


def _product(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float] | None:
    """Squared distances of two blocks by one matrix product, and how far each may be off; none for values that it cannot hold."""
    if not a.size or not b.size:
        return None
    center = b.mean(axis=0)
    x, y = a - center, b - center
    xx, yy = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    off = ROUNDING * (a.shape[1] + 4) * (xx.max() + yy.max())
    if not np.isfinite(off):
        return None
    return np.column_stack([x, xx, np.ones(len(x))]) @ np.column_stack([-2 * y, np.ones(len(y)), yy]).T, off


def _measured(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs (i, j), by the difference as in ``sq_dists``."""
    out, step = np.empty(len(i)), max(1, 4_000_000 // a.shape[1])
    for s in range(0, len(i), step):
        d = a[i[s:s + step]] - b[j[s:s + step]]
        out[s:s + step] = np.einsum("ij,ij->i", d, d)
    return out


def within(a: np.ndarray, b: np.ndarray, limit: float) -> np.ndarray:
    """``sq_dists(a, b) <= limit``: by one matrix product, the pairs near the limit by the difference."""
    got = _product(a, b)
    if got is None:
        return sq_dists(a, b) <= limit
    d, off = got
    inside = d <= limit + off
    i, j = np.nonzero(inside & (d >= limit - off))
    inside[i, j] = _measured(a, b, i, j) <= limit
    return inside


def smallest_sq(a: np.ndarray, b: np.ndarray, k: int, below: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, squared distance), by row and distance, among which are the k smallest of each row of ``a``;
    with ``below``, of those under each row's squared bound. Found by one matrix product, measured by the difference."""
    got = _product(a, b)
    if got is None:
        d = sq_dists(a, b)
        m = min(k, d.shape[1])
        j = np.argpartition(d, m - 1, axis=1)[:, :m] if m else np.zeros((len(a), 0), np.int64)
        i, j = np.repeat(np.arange(len(a)), m), j.ravel()
        d = d[i, j]
        if below is not None:
            keep = d < below[i]
            i, j, d = i[keep], j[keep], d[keep]
    else:
        d, off = got
        if below is None:
            most = np.partition(d, k - 1, axis=1)[:, k - 1] if k < d.shape[1] else np.full(len(a), np.inf)
            i, j = np.nonzero(d <= most[:, None] + 2 * off)
            d = _measured(a, b, i, j)
        else:
            i, j = np.nonzero(d <= below[:, None] + off)
            d = _measured(a, b, i, j)
            keep = d < below[i]
            i, j, d = i[keep], j[keep], d[keep]
    by = np.lexsort((d, i))
    return i[by], j[by], d[by]


def array_dist(a: Column, b: Column) -> Column:
    """Euclidean distance of two array columns."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x))


def pivots(df: DataFrame, id_col: str, vec: str, n_pivots: int, seed: int = 42) -> list[list[float]]:
    """``n_pivots`` data points picked by hash order (a handful of vectors)."""
    rows = df.select(vec).orderBy(F.md5(F.concat(F.lit(f"{seed}:pivot:"), F.col(id_col).cast("string")))) \
        .limit(n_pivots).collect()
    return [list(map(float, r[0])) for r in rows]
