"""Placing rooms: revisit detection by ICP, and the SE(2) pose graph."""

from __future__ import annotations

import numpy as np

from ..operators.components import find_roots
from . import polygons

SE2 = tuple[float, float, float]
OVERLAP_OK, REVISIT_AREA, LEAST_GAP = 0.02, 0.25, 0.01


def wrap(a):
    return np.mod(a + np.pi, 2 * np.pi) - np.pi


def compose(a: SE2, b: SE2) -> SE2:
    c, s = np.cos(a[2]), np.sin(a[2])
    return (float(a[0] + c * b[0] - s * b[1]), float(a[1] + s * b[0] + c * b[1]), float(wrap(a[2] + b[2])))


def relative(a: SE2, b: SE2) -> SE2:
    """b as seen from a."""
    c, s, dx, dy = np.cos(a[2]), np.sin(a[2]), b[0] - a[0], b[1] - a[1]
    return (float(c * dx + s * dy), float(c * dy - s * dx), float(wrap(b[2] - a[2])))


def icp(src: np.ndarray, dst: np.ndarray, rounds: int = 30, tol: float = 1e-6) -> tuple[SE2, float]:
    """The rigid motion that brings src onto dst by nearest points, and their mean distance. The
    rotation of each round has a closed form: the angle of the summed cross and dot products."""
    angle, shift, last, mean = 0.0, np.zeros(2), np.inf, np.inf
    for _ in range(rounds):
        c, s = np.cos(angle), np.sin(angle)
        moved = src @ np.array([[c, s], [-s, c]]) + shift
        d2 = ((moved[:, None] - dst[None]) ** 2).sum(-1)
        to = dst[d2.argmin(1)]
        mean = float(np.sqrt(d2.min(1)).mean())
        a, b = moved - moved.mean(0), to - to.mean(0)
        turn = np.arctan2((a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]).sum(), (a * b).sum())
        c, s = np.cos(turn), np.sin(turn)
        r = np.array([[c, s], [-s, c]])
        shift = shift @ r + to.mean(0) - moved.mean(0) @ r
        angle += turn
        if abs(last - mean) < tol:
            break
        last = mean
    return (float(shift[0]), float(shift[1]), float(wrap(angle))), mean


def reachable(ids: list[str], links: list[tuple[str, str]], start: str) -> set[str]:
    at = {x: k for k, x in enumerate(ids)}
    pairs = np.array([(at[a], at[b]) for a, b in links], int).reshape(-1, 2)
    root = find_roots(len(ids), pairs[:, 0], pairs[:, 1])
    return {x for x in ids if root[at[x]] == root[at[start]]}


def revisits(rings: dict[str, np.ndarray], eligible: set[str]) -> list[dict]:
    """Overlapping pairs that touch the anchored rooms, with the motion of a onto b."""
    out, ids = [], sorted(rings)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if not {a, b} & eligible or not boxes_meet(rings[a], rings[b]):
                continue
            inter = polygons.overlap(rings[a], rings[b])
            if inter < REVISIT_AREA:
                continue
            motion, fit = icp(polygons.resampled(rings[a]), polygons.resampled(rings[b]))
            gap = float(np.hypot(motion[0], motion[1]))
            if gap >= LEAST_GAP:
                out.append({"a": a, "b": b, "motion": motion, "gap": round(gap, 4), "weight": round(min(1.0, inter / 2) / (1 + fit / 0.05), 3)})
    return out


def boxes_meet(a, b, margin: float = 0.0) -> bool:
    return bool((a.min(0) <= b.max(0) + margin).all() and (b.min(0) <= a.max(0) + margin).all())


def pose_graph(ids: list[str], start: dict[str, SE2], constraints: list[tuple[str, str, SE2, float]], anchor: str | None = None) -> tuple[dict[str, SE2], float]:
    """Poses that make each room a lie at `measured` as seen from room b, by damped Gauss-Newton;
    the anchor stays. Returns poses and the mean absolute residual."""
    ids = sorted(ids)
    anchor = anchor or ids[0]
    free = {r: 3 * k for k, r in enumerate(x for x in ids if x != anchor)}
    if not constraints or not free:
        return dict(start), 0.0
    x = np.array([v for r in free for v in start[r]], float)
    pose = lambda x, r: tuple(x[free[r] : free[r] + 3]) if r in free else start[r]

    def residual(x):
        rows = []
        for a, b, measured, weight in constraints:
            e = relative(measured, relative(pose(x, b), pose(x, a)))
            rows += [v * np.sqrt(max(weight, 0.0)) for v in (e[0], e[1], wrap(e[2]))]
        return np.array(rows)

    r, damp = residual(x), 1e-6
    for _ in range(200):
        jac = np.stack([(residual(x + h) - residual(x - h)) / 2e-6 for h in np.eye(len(x)) * 1e-6], 1)
        step = np.linalg.solve(jac.T @ jac + damp * np.eye(len(x)), -jac.T @ r)
        new = residual(x + step)
        if new @ new <= r @ r:
            done = np.abs(step).max() < 1e-12
            x, r, damp = x + step, new, max(damp / 10, 1e-12)
            if done:
                break
        else:
            damp *= 10
            if damp > 1e8:
                break
    poses = {anchor: start[anchor]} | {k: (float(x[i]), float(x[i + 1]), float(x[i + 2])) for k, i in free.items()}
    return poses, float(np.abs(r).mean())


def stitch(rooms: dict[str, np.ndarray], connectors: list[dict], start: dict[str, SE2] | None = None, loop_closure: bool = True) -> dict:
    """Poses of a capture's rooms from door-to-door connectors(a, b, transform, weight) and revisits."""
    ids = sorted(rooms)
    start = {r: (0.0, 0.0, 0.0) for r in ids} | (start or {})
    if not ids:
        return {"poses": {}, "closures": [], "overlap_ok": True, "unstitched": False, "footprint": 0.0, "closure_gap": None, "residual": 0.0}
    links = [(c["a"], c["b"]) for c in connectors]
    either = {*links, *((b, a) for a, b in links)}
    seen = []
    if loop_closure and len(ids) > 1:
        placed = {r: polygons.placed(rooms[r], start[r]) for r in ids}
        seen = [m for m in revisits(placed, reachable(ids, links, ids[0])) if (m["a"], m["b"]) not in either]
    back = [(m["a"], m["b"], relative(start[m["b"]], compose(m["motion"], start[m["a"]])), m["weight"]) for m in seen]
    all_ = [(c["a"], c["b"], c["transform"], c["weight"] or 1.0) for c in connectors] + back
    top = max((c[3] for c in all_), default=1.0)
    poses, residual = pose_graph(ids, start, [(*c[:3], c[3] / top) for c in all_])
    rings = {r: polygons.placed(rooms[r], poses[r]) for r in ids}
    again = {frozenset((m["a"], m["b"])) for m in seen}
    bad = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if frozenset((a, b)) not in again and boxes_meet(rings[a], rings[b]) and polygons.overlap(rings[a], rings[b]) > OVERLAP_OK]
    gaps = [float(np.hypot(*relative(m, relative(poses[b], poses[a]))[:2])) for a, b, m, _ in back]
    whole = reachable(ids, links + [(m["a"], m["b"]) for m in seen], ids[0])
    return {
        "poses": poses, "closures": [{"a": m["a"], "b": m["b"], "gap": m["gap"]} for m in seen], "overlap_ok": not bad, "unstitched": len(whole) < len(ids),
        "footprint": round(polygons.covered_area(list(rings.values())), 4), "closure_gap": round(float(np.mean(gaps)), 4) if gaps else None, "residual": round(residual, 6),
    }


def touching(rings: dict[str, np.ndarray], within: float = 0.05) -> list[tuple[str, str]]:
    """Pairs of placed rooms at most `within` apart."""
    ids = sorted(rings)
    return [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if boxes_meet(rings[a], rings[b], within) and polygons.gap(rings[a], rings[b]) <= within]
