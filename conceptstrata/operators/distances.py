"""Distances between blocks of vectors held by one task."""

from __future__ import annotations

import numpy as np

# Rows of a block: the distance matrix of two blocks takes 32 MB.
BLOCK_ROWS = 2_048
# Sets up to this size are scored by the task that fitted them, larger ones in pairs of blocks.
INLINE_ROWS = 5_000


def euclidean(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    squared = (x**2).sum(axis=1, keepdims=True) - 2.0 * (x @ y.T) + (y**2).sum(axis=1)
    return np.sqrt(np.maximum(squared, 0.0))


def membership(codes: np.ndarray, clusters: int) -> np.ndarray:
    """0/1 matrix of rows by clusters."""
    member = np.zeros((len(codes), clusters))
    member[np.arange(len(codes)), codes] = 1.0
    return member


def mean_silhouettes(points: np.ndarray, labels: list[np.ndarray]) -> list[float]:
    """Exact mean silhouettes of a set one task holds under several labellings; a point alone in its cluster counts 0.

    Every pair of points is measured once for all labellings: the distances of a strip of rows to the rows from there on
    are summed by cluster for both sides.
    """
    coded = [np.unique(own, return_inverse=True) for own in labels]
    cuts = np.cumsum([0, *(len(present) for present, _ in coded)])
    member = np.hstack([membership(codes, len(present)) for present, codes in coded])
    sums = np.zeros_like(member)
    step = max(1, BLOCK_ROWS**2 // len(points))
    for low in range(0, len(points), step):
        high = min(low + step, len(points))
        distance = euclidean(points[low:high], points[low:])
        own = np.arange(high - low)
        distance[own, own] = 0.0
        sums[low:high] += distance @ member[low:]
        sums[high:] += distance[:, high - low :].T @ member[low:high]
    return [_mean_score(sums[:, a:z], member[:, a:z].sum(axis=0), codes) for a, z, (_, codes) in zip(cuts, cuts[1:], coded)]


def _mean_score(sums: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> float:
    if len(sizes) < 2:
        return 0.0
    rows, own = np.arange(len(codes)), sizes[codes]
    a = sums[rows, codes] / np.maximum(own - 1, 1)
    others = sums / sizes
    others[rows, codes] = np.inf
    b = others.min(axis=1)
    width = np.maximum(a, b)
    return float(np.where((own > 1) & (width > 0), (b - a) / np.where(width > 0, width, 1.0), 0.0).mean())


def mean_silhouette(points: np.ndarray, labels: np.ndarray) -> float:
    return mean_silhouettes(points, [labels])[0]
