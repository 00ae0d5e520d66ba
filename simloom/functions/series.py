"""Kernels on two series of state vectors: dynamic time warping and interpolated distance."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


def normalised(x: np.ndarray, how: str = "zscore") -> np.ndarray:
    """Series ``(..., frames, values)`` normalised over their frames; NaN and infinities become 0 first, one frame stays as it is.

    Sums are added up frame by frame and spreads are Welford's, as SQL's are: z-scores of few frames often tie, and then the last bit decides the path.
    """
    if how == "none":
        return x
    if how not in ("zscore", "minmax"):
        raise ValueError(f"unknown normalisation {how!r}")
    x = np.where(np.isfinite(x), x, 0.0)
    if x.shape[-2] < 2:
        return x
    low, spread = mean_and_spread(x) if how == "zscore" else (x.min(axis=-2), np.ptp(x, axis=-2))
    return (x - low[..., None, :]) / np.where(spread < 1e-8, 1.0, spread)[..., None, :]


def mean_and_spread(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation over the frames of series ``(..., frames, values)``, one frame after the other."""
    total, mean, squares = (np.zeros(x.shape[:-2] + x.shape[-1:]) for _ in range(3))
    for n in range(x.shape[-2]):
        one = x[..., n, :]
        total += one
        before = one - mean
        mean += before / (n + 1)
        squares += (one - mean) * before
    return total / x.shape[-2], np.sqrt(squares / x.shape[-2])


def weighted_length(gap: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted lengths of vectors ``(..., values)``; squares are weighted, then added up in the order of the values, as SQL does.

    Squares are the C library's powers, as SQL's are; about one in a thousand isn't the product.
    """
    squares = np.power(gap, np.full_like(gap, 2.0))  # one exponent for all would be turned into a product
    total = weights[0] * squares[..., 0]
    for k in range(1, len(weights)):
        total += weights[k] * squares[..., k]
    return np.sqrt(total)


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Values rounded as DuckDB rounds them: scaled, halves away from zero, scaled back; zeros keep their sign."""
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = x * 10.0**digits
        whole = np.trunc(scaled)
        whole += np.where(np.abs(scaled - whole) >= 0.5, np.sign(scaled), 0.0)
        out = whole / 10.0**digits
    return np.where(np.isfinite(out), np.copysign(out, x), x)


def dtw(a: np.ndarray, b: np.ndarray, weights: np.ndarray, window: int = 0) -> tuple[float, int]:
    """Distance and path length of one pair; see ``dtw_many``."""
    distance, length = dtw_many(a[None], b[None], weights, window)
    return float(distance[0]), int(length[0])


def dtw_many(a: np.ndarray, b: np.ndarray, weights: np.ndarray, window: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Distances and path lengths of pairs ``a[k]``, ``b[k]`` under a band of ``window`` (0: none); of equal moves the diagonal, then up.

    All cells of an anti-diagonal are computed at once, for all pairs, and only those in the band. A
    cell carries the length of the path to it, so that three anti-diagonals are all that is kept.
    """
    pairs, n, m = len(a), a.shape[1], b.shape[1]
    if not n or not m:
        return np.full(pairs, math.inf), np.zeros(pairs, np.int64)
    band = max(window if window > 0 else max(n, m), abs(n - m))
    before, last, now = (np.full((pairs, n + 1), math.inf) for _ in range(3))
    steps_before, steps_last, steps_now = (np.zeros((pairs, n + 1), np.int64) for _ in range(3))
    before[:, 0] = 0.0
    for d in range(2, n + m + 1):
        low, high = max(1, d - m, (d - band + 1) // 2), min(n, d - 1, (d + band) // 2)
        now[:, max(0, low - 2) : low] = math.inf
        if low <= high:
            i = np.arange(low, high + 1)
            gap = a[:, i - 1] - b[:, d - i - 1]
            with np.errstate(invalid="ignore", over="ignore"):
                cost = weighted_length(gap, weights)
            cost = np.nan_to_num(cost, nan=0.0, posinf=1e10, neginf=0.0)
            diagonal, up, left = before[:, low - 1 : high], last[:, low - 1 : high], last[:, low : high + 1]
            first = (diagonal <= up) & (diagonal <= left)
            second = up <= left
            now[:, low : high + 1] = cost + np.where(first, diagonal, np.where(second, up, left))
            steps_now[:, low : high + 1] = 1 + np.where(first, steps_before[:, low - 1 : high], np.where(second, steps_last[:, low - 1 : high], steps_last[:, low : high + 1]))
        before, last, now = last, now, before
        steps_before, steps_last, steps_now = steps_last, steps_now, steps_before
    return last[:, n].copy(), steps_last[:, n].copy()


def interpolated(x: np.ndarray, size: int) -> np.ndarray:
    """Series ``(..., frames, values)`` at ``size`` evenly spread moments, linear in between."""
    frames = x.shape[-2]
    at = np.arange(size) * (frames - 1) / (size - 1)
    low = np.minimum(at.astype(int), max(frames - 2, 0))
    part = (at - low)[:, None]
    return x[..., low, :] * (1 - part) + x[..., np.minimum(low + 1, frames - 1), :] * part


def interpolated_distance(a: np.ndarray, b: np.ndarray, weights: np.ndarray, size: int = 100) -> float | np.ndarray:
    """Mean weighted distance of two series, or of each two of many with as many frames."""
    if not a.shape[-2] or not b.shape[-2]:
        return math.inf if a.ndim == 2 else np.full(len(a), math.inf)
    gap = interpolated(a, size) - interpolated(b, size)
    return mean_in_order(weighted_length(gap, weights))


def mean_in_order(x: np.ndarray) -> np.ndarray:
    """Means over the last axis, added up from the first value to the last; NumPy's own sums are by pairs."""
    return np.add.accumulate(x, axis=-1)[..., -1] / x.shape[-1]


def assignment(cost: np.ndarray) -> np.ndarray:
    """The column of each row in an assignment of least cost (rows <= columns)."""
    return assigned(cost.__getitem__, *cost.shape)


def assigned(cost_of: Callable[[int], np.ndarray], n: int, m: int) -> np.ndarray:
    """As ``assignment``, by shortest augmenting paths; ``cost_of`` gives a row's costs, so that no matrix is needed."""
    if n > m:
        raise ValueError("more rows than columns")
    u, v = np.zeros(n), np.zeros(m)
    row_of, column_of = np.full(m, -1), np.full(n, -1)
    for first in range(n):
        least, way, open_v = np.full(m, math.inf), np.full(m, -1), v.copy()
        i, low, columns, reached = first, 0.0, [], []
        while True:
            reduced = cost_of(i) - open_v
            reduced += low - u[i]
            closer = reduced < least
            np.copyto(least, reduced, where=closer)
            np.copyto(way, i, where=closer)
            j = int(least.argmin())
            low = float(least[j])
            if row_of[j] < 0:
                break
            columns.append(j)
            reached.append(low)
            least[j], open_v[j] = math.inf, -math.inf
            i = int(row_of[j])
        u[first] += low
        u[row_of[columns]] += low - np.array(reached)
        v[columns] -= low - np.array(reached)
        while True:
            i = int(way[j])
            row_of[j] = i
            column_of[i], j = j, int(column_of[i])
            if i == first:
                break
    return column_of
