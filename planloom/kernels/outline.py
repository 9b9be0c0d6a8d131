"""The outline of a single room from its floor and its fitted walls: an older way to a plan, for captures
of one room. The floor's occupied cells give a ring, the walls of `box` straighten it, and every corner
and edge says how far it goes beyond what was seen."""

from __future__ import annotations

import numpy as np

from . import box, polygons, raster, walls

#: Fixed values of the method, in metres unless told otherwise.
PARAMS = {
    "cell": 0.10, "trim": (0.5, 99.5), "simplify": 0.12, "least_area": 2.0, "short": 0.20, "chord": 0.20, "straight_deg": 8.0, "most_points": 16, "most_simplify": 1.0,
    "step": 0.30, "most_edges": 8, "seen": 0.20, "ci_per_m": 0.05, "odometry": 0.01, "unseen_scale": 2.0, "weak": 0.5, "inset": (0.3, 0.7), "long": 1.2, "slab": 0.08, "least_wall": 0.30,
}


# ---- from floor cells to a ring --------------------------------------------------------------


def eroded(mask: np.ndarray, radius: int) -> np.ndarray:
    """What is left when every cell that has an empty one (beyond the border all is empty) at most
    `radius` away on both axes goes."""
    return ~raster.grown(np.pad(~mask, radius, constant_values=True), radius)[radius:-radius, radius:-radius]


def floor_mask(uv: np.ndarray, p: dict) -> tuple[np.ndarray, np.ndarray]:
    """Occupied cells, and the corner that cell (0, 0) begins at. Rows are the first axis. Points outside
    the percentiles don't count."""
    lo, hi = np.percentile(uv, p["trim"], axis=0)
    kept = uv[((uv >= lo) & (uv <= hi)).all(1)]
    kept = kept if len(kept) else uv
    at = np.floor(kept / p["cell"]).astype(np.int64)
    first = at.min(0) - 2
    mask = np.zeros(at.max(0) - first + 3, bool)
    mask[tuple((at - first).T)] = True
    return mask, first * p["cell"]


def solid(mask: np.ndarray) -> np.ndarray:
    """Small gaps closed, single teeth cut off, holes filled, and of that the largest piece."""
    wide = np.pad(mask, 2)
    shut = eroded(raster.grown(wide, 2), 2)
    smooth = raster.grown(eroded(shut, 1), 1)
    numbers, n = raster.label(raster.fill_holes(smooth))
    if not n:
        return np.zeros_like(mask)
    return (numbers == np.bincount(numbers.ravel())[1:].argmax() + 1)[2:-2, 2:-2]


def simplified(ring: np.ndarray, tol: float) -> np.ndarray:
    """Douglas-Peucker on a closed ring, cut at its first corner and the one furthest from it."""
    far = int(np.hypot(*(ring - ring[0]).T).argmax())
    closed, keep, parts = np.vstack([ring, ring[:1]]), np.zeros(len(ring) + 1, bool), [(0, far), (far, len(ring))]
    keep[[0, far]] = True
    while parts:
        a, b = parts.pop()
        if b - a < 2:
            continue
        chord, inner = closed[b] - closed[a], closed[a + 1 : b] - closed[a]
        n = float(np.hypot(*chord))
        d = np.abs(chord[0] * inner[:, 1] - chord[1] * inner[:, 0]) / n if n > 1e-12 else np.hypot(*inner.T)
        k = int(d.argmax())
        if d[k] > tol:
            keep[a + 1 + k] = True
            parts += [(a, a + 1 + k), (a + 1 + k, b)]
    return ring[keep[:-1]]


def straightened(ring: np.ndarray, p: dict, short: float | None = None, chord: float | None = None) -> np.ndarray:
    """The ring without corners that end a short edge, hardly turn, or lie close to the chord of their
    neighbours; one at a time, until none is left."""
    short, chord = p["short"] if short is None else short, p["chord"] if chord is None else chord
    pts = [tuple(x) for x in ring.tolist()]
    turn = np.radians(p["straight_deg"])
    while len(pts) > 3:
        x = np.array(pts)
        before, after = np.roll(x, 1, 0), np.roll(x, -1, 0)
        a, b, c = x - before, after - x, after - before
        size = np.hypot(*b.T)
        bend = np.abs(np.arctan2(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0], (a * b).sum(1)))
        off = np.abs(c[:, 0] * a[:, 1] - c[:, 1] * a[:, 0]) / np.maximum(np.hypot(*c.T), 1e-12)
        gone = next((i for rule in (size < short, bend < turn, off < chord) for i in np.flatnonzero(rule)[:1]), None)
        if gone is None:
            break
        del pts[int(gone)]
    return np.array(pts)


def footprint(uv: np.ndarray, p: dict | None = None) -> np.ndarray | None:
    """The counter-clockwise ring around the floor's largest piece, simplified further and further until it
    has few corners; None if there is too little floor."""
    p = PARAMS | (p or {})
    if len(uv) < 4:
        return None
    mask, origin = floor_mask(uv, p)
    mask = solid(mask)
    if mask.sum() * p["cell"] ** 2 < p["least_area"]:
        return None
    raw = np.array(polygons.outline(mask), float) * p["cell"] + origin
    tol = p["simplify"]
    ring = straightened(simplified(raw, tol), p)
    while len(ring) > p["most_points"] and tol <= p["most_simplify"]:
        tol *= 1.5
        ring = straightened(simplified(raw, tol), p)
    return counter_clockwise(ring) if len(ring) >= 3 and polygons.area(ring) >= p["least_area"] else None


# ---- rings by wall lines ---------------------------------------------------------------------


def counter_clockwise(ring: np.ndarray) -> np.ndarray:
    x, y = ring.T
    return ring if (x * np.roll(y, -1) - np.roll(x, -1) * y).sum() >= 0 else ring[::-1]


def nearest_line(values: np.ndarray, lines: list[float], tol: float) -> np.ndarray:
    """Each value, or the nearest line if that is at most `tol` away."""
    lines = np.array(lines)
    best = lines[np.abs(values[:, None] - lines[None]).argmin(1)]
    return np.where(np.abs(values - best) <= tol, best, values)


def snapped(ring: np.ndarray, us: list[float], vs: list[float], tol: float) -> np.ndarray:
    return np.stack([nearest_line(ring[:, 0], us, tol), nearest_line(ring[:, 1], vs, tol)], 1)


def orthogonal(ring: np.ndarray, us: list[float], vs: list[float], tol: float) -> np.ndarray:
    """A ring of edges along the axes only: each edge takes the axis that it follows more, at its middle or
    the wall line near it; corners are where neighbouring edges of different axes meet."""
    d, mid = np.roll(ring, -1, 0) - ring, (np.roll(ring, -1, 0) + ring) / 2
    flat = np.abs(d[:, 0]) >= np.abs(d[:, 1])
    at = np.where(flat, nearest_line(mid[:, 1], vs, tol), nearest_line(mid[:, 0], us, tol))
    last = np.flatnonzero(flat != np.roll(flat, -1))  # of a run of edges along one axis the last one counts
    if len(last) < 4:
        return ring
    flat, at = flat[last], at[last]
    return np.array([(at[k - 1], at[k]) if flat[k] else (at[k], at[k - 1]) for k in range(len(last))])


def fewer_edges(ring: np.ndarray, most: int) -> np.ndarray:
    """Without the corners that begin the shortest edges, until `most` are left."""
    while len(ring) > max(most, 4):
        ring = np.delete(ring, int(np.hypot(*(np.roll(ring, -1, 0) - ring).T).argmin()), 0)
    return ring


def support_span(uv: np.ndarray, axis: int, offset: float, tol: float = box.SLAB) -> tuple[float, float] | None:
    """How far cells near a wall line reach along it."""
    near = uv[np.abs(uv[:, axis] - offset) <= tol, 1 - axis]
    return (float(near.min()), float(near.max())) if len(near) else None


def beyond(span: tuple[float, float] | None, at: float) -> float | None:
    """How far a place lies beyond a span; None without one."""
    return None if span is None else max(span[0] - at, at - span[1], 0.0)


def hidden_sides(uv: np.ndarray, lines: dict[str, float], p: dict | None = None) -> list[str]:
    """Sides behind whose line another long one runs a little further out: furniture may stand before the wall."""
    p = PARAMS | (p or {})
    out = []
    for name, (axis, sign) in box.SIDES.items():
        across, along = uv[:, axis], uv[:, 1 - axis]
        edges = np.arange(across.min() - 0.1, across.max() + 0.1 + box.CELL, box.CELL)
        h = np.convolve(np.histogram(across, edges)[0], np.ones(5) / 5, "same")
        peak = np.flatnonzero((h[1:-1] >= h[:-2]) & (h[1:-1] > h[2:]) & (h[1:-1] > 0)) + 1
        mid = (edges[peak] + edges[peak + 1]) / 2
        for m in mid[((mid - lines[name]) * sign >= p["inset"][0]) & ((mid - lines[name]) * sign <= p["inset"][1])]:
            near = np.abs(across - m) < 0.05
            line = float(np.median(across[near])) if near.any() else float(m)
            if box.longest_run(along[np.abs(across - line) < box.SLAB]) >= p["long"]:
                out.append(name)
                break
    return out


def outline(floor_uv: np.ndarray, uv: np.ndarray, lines: dict[str, float | None], p: dict | None = None) -> dict | None:
    """ring, method and corners (u, v, provenance, extrapolation, half). A side without a wall is as far as
    cells reach; without a usable floor the ring is the box of the sides. None without anything."""
    p = PARAMS | (p or {})
    if not len(uv) and None in lines.values():
        return None
    ends = {n: lines[n] if lines[n] is not None else float((uv[:, a].min, uv[:, a].max)[s > 0]()) for n, (a, s) in box.SIDES.items()}
    us, vs = [ends["u_min"], ends["u_max"]], [ends["v_min"], ends["v_max"]]
    if us[1] - us[0] < 0.3 or vs[1] - vs[0] < 0.3:
        return None
    ring = footprint(floor_uv, p)
    if ring is not None:
        ring = fewer_edges(straightened(snapped(ring, us, vs, p["step"]), p, p["step"], p["step"]), p["most_edges"])
        ring = counter_clockwise(ring) if len(ring) >= 4 and polygons.area(ring) >= 0.5 else None
    method = "walls and floor" if ring is not None else "walls" if None not in lines.values() else "walls, some as far as cells reach"
    if ring is None:
        ring = np.array([(us[0], vs[0]), (us[1], vs[0]), (us[1], vs[1]), (us[0], vs[1])])
    diagonal = float(np.hypot(us[1] - us[0], vs[1] - vs[0]))
    corners = []
    for u, v in ring.tolist():
        d = min(float(np.hypot(*(uv - (u, v)).T).min()), diagonal) if len(uv) else diagonal
        corners.append({"u": u, "v": v, "provenance": "observed" if d <= p["seen"] else "inferred", "extrapolation": d, "half": p["ci_per_m"] * d})
    return {"ring": ring, "method": method, "corners": corners}


def half_width(position: float, length: float, state: str, extrapolation: float, p: dict | None = None) -> float:
    """Of an edge's length: the position's and the odometry's share in quadrature, doubled unless the edge was
    seen, and the share of what was extrapolated."""
    p = PARAMS | (p or {})
    half = np.hypot(position, p["odometry"] * length) * (1.0 if state == "observed" else p["unseen_scale"])
    return float(np.hypot(max(half, 1e-3), p["ci_per_m"] * extrapolation))


def inside_fraction(ring, xy: np.ndarray) -> float | None:
    return float(polygons.contains(ring, xy).mean()) if len(ring) >= 3 and len(xy) else None


def region_features(uv: np.ndarray, heights: np.ndarray, lines: dict[str, float], p: dict | None = None) -> list[dict]:
    """Of each 8-connected region of the cells above the skirting: cells, run, greatest height, inset from the
    nearest wall line, that side, whether it lies within the lines, and its box. rules.region_label() names it."""
    p = PARAMS | (p or {})
    if not len(uv):
        return []
    at = np.floor(uv / p["cell"]).astype(np.int64)
    first = at.min(0)
    mask, top = np.zeros(at.max(0) - first + 1, bool), np.zeros(at.max(0) - first + 1)
    mask[tuple((at - first).T)] = True
    np.maximum.at(top, tuple((at - first).T), heights)
    numbers, n = raster.label(mask, diagonal=True)
    out = []
    for k in range(1, n + 1):
        i, j = np.nonzero(numbers == k)
        u, v = ((x + f + 0.5) * p["cell"] for x, f in zip((i, j), first, strict=True))
        centre = (float(u.mean()), float(v.mean()))
        far = {name: abs(centre[axis] - lines[name]) for name, (axis, _) in box.SIDES.items()}
        side = min(far, key=far.get)
        within = all(lines[f"{c}_min"] - 0.15 <= x <= lines[f"{c}_max"] + 0.15 for c, x in zip("uv", centre, strict=True))
        size = [float(x.max() - x.min()) + p["cell"] for x in (u, v)]
        out.append({"cells": len(i), "u": centre[0], "v": centre[1], "run": max(box.longest_run(u), box.longest_run(v)), "height": float(top[i, j].max()), "inset": far[side], "side": side, "within": within, "area": round(size[0] * size[1], 4)})
    return out


def fit(points: np.ndarray, camera: np.ndarray, floor_y: float, ceil_y: float | None = None, samples: int = 200, seed: int = 0, p: dict | None = None) -> dict:
    """Everything about a single room: the box of `box.fit`, the outline in the world with area and interval,
    its edges, regions, doors, hidden sides and how much of the camera's path lies inside."""
    p = PARAMS | (p or {})
    found = box.fit(points, camera, floor_y, ceil_y, samples, seed)
    warnings = list(found["warnings"])
    lines = found.get("walls") or dict.fromkeys(box.SIDES)
    if "angle" not in found:
        return {"status": "unavailable", "warnings": warnings, "edges": [], "regions": [], "doors": []}
    angle = found["angle"]
    turned = lambda xyz: walls.rotated(xyz[:, [0, 2]], angle)
    cells = walls.rotated(box.wall_cells(points, floor_y, ceil_y), angle)
    drawn = outline(turned(points[np.abs(points[:, 1] - floor_y) <= p["slab"]]), cells, lines, p)
    if drawn is None:
        return {"status": "unavailable", "warnings": [*warnings, "no outline"], "edges": [], "regions": [], "doors": []}
    whole = None not in lines.values()
    hidden = hidden_sides(cells, lines, p) if whole else []
    warnings += [f"{s}: a long line further out" for s in hidden]
    above = points[:, 1] > floor_y + 0.25
    regions = region_features(turned(points[above]), points[above, 1] - floor_y, lines, p) if whole else []
    ring, edges = drawn["ring"], []
    spread = {s: found.get("width" if s[0] == "u" else "depth") for s in box.SIDES}
    for k, (a, b) in enumerate(zip(ring, np.roll(ring, -1, 0), strict=True)):
        length = float(np.hypot(*(b - a)))
        if length < p["least_wall"]:
            continue
        mid = (a + b) / 2
        far = {n: abs(mid[axis] - lines[n]) for n, (axis, _) in box.SIDES.items() if lines[n] is not None}
        side = min(far, key=far.get) if far else "step"
        side = side if far and far[side] <= 0.20 else "step"
        cover = found.get("coverage", {}).get(side)
        state = "observed" if side == "step" else "unobserved" if cover is None else "partially_occluded" if side in hidden else "partially_observed" if cover < p["weak"] else "observed"
        ends = [drawn["corners"][k], drawn["corners"][(k + 1) % len(ring)]]
        ci = spread.get(side)
        position = (ci[2] - ci[1]) / 2 if ci and ci[1] is not None else 0.0
        beyond_seen = max(c["extrapolation"] for c in ends)
        edges.append({"side": side, "state": state, "provenance": "inferred" if any(c["provenance"] == "inferred" for c in ends) else "observed", "extrapolation": beyond_seen, "coverage": cover, "length": length, "half": half_width(position, length, state, beyond_seen, p)})
    area = polygons.area(ring)
    ci = found.get("area")
    half = float(np.hypot((ci[2] - ci[1]) / 2 if ci and ci[1] is not None else 0.0, p["odometry"] * area))
    inside = inside_fraction(ring, turned(camera))
    if inside is not None and inside < 0.99:
        warnings.append(f"only {inside:.0%} of the camera's path lies inside")
    c, s = np.cos(np.radians(angle)), np.sin(np.radians(angle))
    world = ring @ np.array([[c, s], [-s, c]])
    return {
        "status": "computed", "angle": angle, "ring": world, "method": drawn["method"], "corners": drawn["corners"], "edges": edges, "area": (area, area - half, area + half), "perimeter": float(np.hypot(*(np.roll(ring, -1, 0) - ring).T).sum()),
        "ceiling": None if ceil_y is None else ceil_y - floor_y, "regions": regions, "doors": found.get("doors", []), "hidden": hidden, "camera_inside": inside, "warnings": warnings,
    }
