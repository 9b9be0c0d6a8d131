"""A single room as a box: the nearest long wall beyond the camera on each side, with intervals by
resampling. An older method than `rooms`, kept for single-room captures."""

from __future__ import annotations

import numpy as np

from . import walls

SIDES = {"u_min": (0, -1), "u_max": (0, 1), "v_min": (1, -1), "v_max": (1, 1)}
CELL, BINS, LEAST_BINS, PEAK_SHARE, MARGIN, SLAB, STEP = 0.02, 10, 4, 0.15, 0.10, 0.06, 0.05


def wall_cells(points: np.ndarray, floor_y: float, ceil_y: float | None = None) -> np.ndarray:
    """Centres of the cells of the wall band that are filled at enough heights."""
    low, high = floor_y + 0.25, floor_y + 1.9 if ceil_y is None else ceil_y - 0.25
    p = points[(points[:, 1] > low) & (points[:, 1] < high)]
    if not len(p):
        return np.zeros((0, 2))
    level = np.clip(((p[:, 1] - low) / (high - low) * BINS).astype(int), 0, BINS - 1)
    keys = np.unique(np.column_stack([np.floor(p[:, [0, 2]] / CELL).astype(np.int64), level]), axis=0)
    cells, n = np.unique(keys[:, :2], axis=0, return_counts=True)
    return (cells[n >= LEAST_BINS] + 0.5) * CELL


def orientation(xz: np.ndarray, step: float = 1.0) -> float:
    """Degrees, under 90, of the turn with the smallest box around all but one percent on each side."""
    turns = np.arange(0, 90, step)
    spans = [np.diff(np.percentile(walls.rotated(xz, t), [1, 99], axis=0), axis=0).prod() for t in turns]
    return float(turns[int(np.argmin(spans))])


def longest_run(along: np.ndarray, gap: float = 0.10) -> float:
    """Metres of the longest stretch of filled bins, small gaps included."""
    if not len(along):
        return 0.0
    edges = np.arange(along.min(), along.max() + STEP, STEP)
    full = np.flatnonzero(np.histogram(along, edges)[0]) if len(edges) > 1 else np.zeros(0, int)
    if not len(full):
        return 0.0
    cut = np.flatnonzero(np.diff(full) > round(gap / STEP) + 1)
    return float((full[np.append(cut, len(full) - 1)] - full[np.append(0, cut + 1)] + 1).max() * STEP)


def side(uv: np.ndarray, axis: int, sign: int, beyond: float, min_run: float = 1.2) -> float | None:
    """Offset of the nearest line beyond the camera whose peak is strong enough and whose run is long."""
    across, along = uv[:, axis], uv[:, 1 - axis]
    edges = np.arange(across.min() - 0.1, across.max() + 0.1 + CELL, CELL)
    h = np.convolve(np.histogram(across, edges)[0], np.ones(5) / 5, "same")
    mid = (edges[:-1] + edges[1:]) / 2
    peak = np.flatnonzero((h[1:-1] >= h[:-2]) & (h[1:-1] > h[2:]) & (h[1:-1] > 0)) + 1
    if not len(peak):
        return None
    peak = peak[(h[peak] >= PEAK_SHARE * h[peak].max()) & (sign * (mid[peak] - beyond) > MARGIN)]
    for i in peak[np.argsort(sign * mid[peak], kind="stable")]:
        near = np.abs(across - mid[i]) < 0.05
        at = float(np.median(across[near])) if near.any() else float(mid[i])
        if longest_run(along[np.abs(across - at) < SLAB]) >= min_run:
            return at
    return None


def find(uv: np.ndarray, cam: np.ndarray) -> dict[str, float | None]:
    return {name: side(uv, axis, sign, float(cam[:, axis].max() if sign > 0 else cam[:, axis].min())) for name, (axis, sign) in SIDES.items()}


def spans(box: dict[str, float]) -> dict[str, tuple[float, float]]:
    return {name: (box["v_min"], box["v_max"]) if axis == 0 else (box["u_min"], box["u_max"]) for name, (axis, _) in SIDES.items()}


def coverage(uv: np.ndarray, box: dict[str, float]) -> dict[str, float]:
    """Share of each wall's 5 cm bins with a cell nearby."""
    out = {}
    for name, (lo, hi) in spans(box).items():
        axis = SIDES[name][0]
        edges = np.arange(lo, hi + STEP, STEP)
        near = uv[np.abs(uv[:, axis] - box[name]) < SLAB, 1 - axis]
        out[name] = float((np.histogram(near, edges)[0] > 0).mean()) if len(edges) > 1 else 0.0
    return out


def doors(uv: np.ndarray, box: dict[str, float], least: float = 0.55, most: float = 1.6) -> list[dict]:
    """Empty stretches inside a wall that are as wide as a door, with the wall's cell density as confidence."""
    out = []
    for name, (lo, hi) in spans(box).items():
        axis = SIDES[name][0]
        near = uv[np.abs(uv[:, axis] - box[name]) < SLAB, 1 - axis]
        edges = np.arange(lo, hi + STEP, STEP)
        if len(edges) < 3:
            continue
        full = np.histogram(near, edges)[0] > 0
        at = np.flatnonzero(full)
        for a, b in zip(at[:-1], at[1:], strict=True):
            if least <= (b - a - 1) * STEP <= most:
                out.append({"wall": name, "start": float(edges[a + 1]), "end": float(edges[b]), "width": round(float((b - a - 1) * STEP), 4), "confidence": float(full.mean())})
    return out


def fit(points: np.ndarray, camera: np.ndarray, floor_y: float, ceil_y: float | None = None, samples: int = 200, seed: int = 0, least_coverage: float = 0.5) -> dict:
    """Walls, size and area with 95 percent intervals from resampled cells (none under eleven fits)."""
    cells = wall_cells(points, floor_y, ceil_y)
    out: dict = {"cells": len(cells), "warnings": []}
    if len(cells) < 200:
        return out | {"warnings": ["too few wall cells"]}
    angle = walls.manhattan_angle(cells)
    uv, cam = walls.rotated(cells, angle), walls.rotated(camera[:, [0, 2]], angle)
    box = find(uv, cam)
    out |= {"angle": angle, "walls": box}
    missing = [k for k, v in box.items() if v is None]
    if missing:
        return out | {"warnings": [f"walls not found: {missing}"]}
    out["coverage"] = coverage(uv, box)
    weak = [k for k, v in out["coverage"].items() if v < least_coverage]
    if weak:
        out["warnings"].append(f"weak coverage: {weak}")
    rng = np.random.default_rng(seed)
    drawn = [find(uv[rng.integers(0, len(uv), len(uv))], cam) for _ in range(samples)]
    size = np.array([(b["u_max"] - b["u_min"], b["v_max"] - b["v_min"]) for b in drawn if None not in b.values()]).reshape(-1, 2)
    width, depth = box["u_max"] - box["u_min"], box["v_max"] - box["v_min"]
    ci = lambda x: tuple(float(v) for v in np.percentile(x, [2.5, 97.5])) if len(x) > 10 else (None, None)
    return out | {"width": (width, *ci(size[:, 0])), "depth": (depth, *ci(size[:, 1])), "area": (width * depth, *ci(size.prod(1))), "doors": doors(uv, box)}
