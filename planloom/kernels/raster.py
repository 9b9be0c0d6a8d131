"""Boolean rasters: labels, closing, holes, distance, runs."""

from __future__ import annotations

import numpy as np

from ..operators.components import find_roots


def label(mask: np.ndarray, diagonal: bool = False) -> tuple[np.ndarray, int]:
    """Components of the true cells numbered from 1 in raster order of their first cell; 0 elsewhere."""
    ids = np.full(mask.shape, -1)
    ids[mask] = np.arange(mask.sum())
    left, right = [], []
    for di, dj in ((0, 1), (1, 0), *(((1, 1), (1, -1)) if diagonal else ())):
        a = ids[: ids.shape[0] - di, max(0, -dj) : ids.shape[1] - max(0, dj)]
        b = ids[di:, max(0, dj) : ids.shape[1] - max(0, -dj)]
        both = (a >= 0) & (b >= 0)
        left.append(a[both])
        right.append(b[both])
    root = find_roots(int(mask.sum()), np.concatenate(left), np.concatenate(right))
    firsts, number = np.unique(root, return_inverse=True)
    out = np.zeros(mask.shape, np.int64)
    out[mask] = number + 1
    return out, len(firsts)


def _shift_all(mask: np.ndarray, combine, outside: bool) -> np.ndarray:
    p = np.pad(mask, 1, constant_values=outside)
    return combine.reduce([p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]])


def close_cross(mask: np.ndarray) -> np.ndarray:
    """Dilation, then erosion, by the five-cell cross; beyond the border all is empty."""
    return _shift_all(_shift_all(mask, np.logical_or, False), np.logical_and, False)


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """The mask with all that the outside cannot reach through its empty cells."""
    outer, _ = label(np.pad(~mask, 1, constant_values=True))
    return (outer != outer[0, 0])[1:-1, 1:-1] if mask.size else mask


def grown(mask: np.ndarray, radius: int) -> np.ndarray:
    """Every cell at most `radius` away on both axes from a true one."""
    p = np.pad(mask, radius).astype(np.int64)
    total = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    k = 2 * radius + 1
    return (total[k:, k:] - total[:-k, k:] - total[k:, :-k] + total[:-k, :-k]) > 0


def inradius(mask: np.ndarray) -> float:
    """The largest Euclidean distance, in cells, of a true cell to the nearest empty one (beyond the border all is empty)."""
    if not mask.any():
        return 0.0
    p = np.pad(mask, 1)
    n, m = p.shape
    # down each column the distance to the nearest empty row, then along rows the lower envelope
    col = np.where(p, n + m, 0).astype(np.float64)
    for i in range(1, n):
        col[i] = np.minimum(col[i], col[i - 1] + 1)
    for i in range(n - 2, -1, -1):
        col[i] = np.minimum(col[i], col[i + 1] + 1)
    best = col**2
    reach = int(np.sqrt(best.max())) + 1
    squares = col**2
    for k in range(1, min(reach, m - 1) + 1):
        best[:, k:] = np.minimum(best[:, k:], squares[:, :-k] + k * k)
        best[:, :-k] = np.minimum(best[:, :-k], squares[:, k:] + k * k)
    return float(np.sqrt(best.max()))
