"""Polygon kernels: exact areas of unions and intersections by slabs, rectilinear set algebra by
coordinate compression, and outlines of cell sets."""

from __future__ import annotations

import numpy as np

Ring = list[tuple[float, float]]


def area(ring) -> float:
    r = np.asarray(ring, float).reshape(-1, 2)
    if len(r) < 3:
        return 0.0
    n = np.roll(r, -1, 0)
    return float(abs((r[:, 0] * n[:, 1] - n[:, 0] * r[:, 1]).sum()) / 2)


def contains(ring, xy: np.ndarray) -> np.ndarray:
    """Ray casting with half-open edges."""
    r = np.asarray(ring, float).reshape(-1, 2)
    odd = np.zeros(len(xy), bool)
    for (x0, y0), (x1, y1) in zip(r, np.roll(r, -1, 0), strict=True):
        if y0 != y1:
            up = (y0 > xy[:, 1]) != (y1 > xy[:, 1])
            odd ^= up & (xy[:, 0] < x0 + (xy[:, 1] - y0) / (y1 - y0) * (x1 - x0))
    return odd


def edges_of(ring) -> np.ndarray:
    r = np.asarray(ring, float).reshape(-1, 2)
    return np.concatenate([r, np.roll(r, -1, 0)], 1)


def distance(ring, xy: np.ndarray) -> np.ndarray:
    """Of points to the ring's nearest edge."""
    out = np.full(len(xy), np.inf)
    for x0, y0, x1, y1 in edges_of(ring):
        d = np.array([x1 - x0, y1 - y0])
        n2 = float(d @ d)
        t = np.clip(((xy - [x0, y0]) @ d) / n2, 0, 1) if n2 else np.zeros(len(xy))
        out = np.minimum(out, np.hypot(*(xy - [x0, y0] - t[:, None] * d).T))
    return out


def gap(a, b) -> float:
    """Distance of two rings (0 where one holds a corner of the other, or they cross)."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    if contains(a, b).any() or contains(b, a).any() or crossings(edges_of(a), edges_of(b)).size:
        return 0.0
    return float(min(distance(a, b).min(), distance(b, a).min()))


def crossings(e: np.ndarray, f: np.ndarray) -> np.ndarray:
    """The y of every point in which an edge of e meets one of f (parallel ones apart)."""
    p, r = e[:, None, :2], (e[:, 2:] - e[:, :2])[:, None]
    q, s = f[None, :, :2], (f[:, 2:] - f[:, :2])[None]
    den = r[..., 0] * s[..., 1] - r[..., 1] * s[..., 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = ((q - p)[..., 0] * s[..., 1] - (q - p)[..., 1] * s[..., 0]) / den
        u = ((q - p)[..., 0] * r[..., 1] - (q - p)[..., 1] * r[..., 0]) / den
    ok = (np.abs(den) > 1e-15) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    return (p[..., 1] + np.where(ok, t, 0) * r[..., 1])[ok]


def covered_area(rings: list, least: int = 1) -> float:
    """Area of what at least `least` of the rings cover. Between two neighbouring heights of corners
    and crossings no edges cross, so a slab's area is its middle width times its height."""
    rings = [np.asarray(r, float).reshape(-1, 2) for r in rings if len(r) >= 3]
    if len(rings) < least:
        return 0.0
    e = np.concatenate([edges_of(r) for r in rings])
    owner = np.repeat(np.arange(len(rings)), [len(r) for r in rings])
    ys = np.unique(np.concatenate([e[:, 1], crossings(e, e)]))
    total = 0.0
    for lo, hi in zip(ys[:-1], ys[1:], strict=True):
        y = (lo + hi) / 2
        hit = (e[:, 1] > y) != (e[:, 3] > y)
        if hi - lo < 1e-12 or not hit.any():
            continue
        h = e[hit]
        x = h[:, 0] + (y - h[:, 1]) / (h[:, 3] - h[:, 1]) * (h[:, 2] - h[:, 0])
        who = owner[hit]
        order = np.argsort(x, kind="stable")
        x, who = x[order], who[order]
        inside = np.zeros(len(rings), bool)
        for k in range(len(x) - 1):
            inside[who[k]] ^= True
            if inside.sum() >= least:
                total += (x[k + 1] - x[k]) * (hi - lo)
    return float(total)


def overlap(a, b) -> float:
    return covered_area([a, b], 2)


def is_simple(ring) -> bool:
    """Whether no two edges that are not neighbours touch, and none has length zero."""
    e = edges_of(ring)
    n = len(e)
    if n < 3 or (np.hypot(*(e[:, 2:] - e[:, :2]).T) < 1e-12).any():
        return False
    for i in range(n):
        for j in range(i + 1, n):
            next_to = j == i + 1 or (i == 0 and j == n - 1)
            a, b = e[i : i + 1], e[j : j + 1]
            if not next_to and (crossings(a, b).size or min(distance(a.reshape(2, 2), b.reshape(2, 2)).min(), distance(b.reshape(2, 2), a.reshape(2, 2)).min()) < 1e-12):
                return False
    return True


# ---- rectilinear rings -----------------------------------------------------------------------


def compressed(*rings) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Common coordinates of rectilinear rings, and each ring as a mask of the cells between them."""
    pts = [np.asarray(r, float).reshape(-1, 2) for r in rings]
    xs, ys = (np.unique(np.concatenate([p[:, k] for p in pts]).round(9)) for k in (0, 1))
    mid = np.stack(np.meshgrid((xs[:-1] + xs[1:]) / 2, (ys[:-1] + ys[1:]) / 2, indexing="ij"), -1).reshape(-1, 2)
    return xs, ys, [contains(p, mid).reshape(len(xs) - 1, len(ys) - 1) for p in pts]


def outline(mask: np.ndarray) -> list[tuple[int, int]]:
    """Corners of the outer boundary of a cell set, interior on the left; of several loops the one
    with the least start. At a corner where four edges meet, straight on comes first."""
    p = np.pad(mask, 1)
    here = p[1:-1, 1:-1]
    follow: dict[tuple[int, int], list[tuple[int, int]]] = {}
    sides = {(0, -1): ((0, 0), (1, 0)), (1, 0): ((1, 0), (1, 1)), (0, 1): ((1, 1), (0, 1)), (-1, 0): ((0, 1), (0, 0))}
    for (di, dj), (a, b) in sides.items():
        open_side = here & ~p[1 + di : p.shape[0] - 1 + di, 1 + dj : p.shape[1] - 1 + dj]
        for i, j in np.argwhere(open_side).tolist():
            follow.setdefault((i + a[0], j + a[1]), []).append((i + b[0], j + b[1]))
    if not follow:
        return []
    at = min(follow)
    loop, last = [at], None
    while True:
        ahead = None if last is None else (2 * at[0] - last[0], 2 * at[1] - last[1])
        step = min(follow[at], key=lambda c: (c != ahead, c))
        last, at = at, step
        if at == loop[0]:
            break
        loop.append(at)
    return [c for k, c in enumerate(loop) if (c[0] - loop[k - 1][0], c[1] - loop[k - 1][1]) != (loop[(k + 1) % len(loop)][0] - c[0], loop[(k + 1) % len(loop)][1] - c[1])]


def ring_of(mask: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> Ring:
    """The outline of the largest 4-connected part of a mask over compressed coordinates."""
    from .raster import label

    parts, n = label(mask)
    if not n:
        return []
    size = np.diff(xs)[:, None] * np.diff(ys)[None, :]
    k = max(range(1, n + 1), key=lambda q: (size[parts == q].sum(), -q))
    return tidy([(float(xs[i]), float(ys[j])) for i, j in outline(parts == k)])


def tidy(ring: Ring) -> Ring:
    """Without the corners that do not turn."""
    out = []
    for k, c in enumerate(ring):
        a, b = ring[k - 1], ring[(k + 1) % len(ring)]
        if abs((c[0] - a[0]) * (b[1] - c[1]) - (c[1] - a[1]) * (b[0] - c[0])) > 1e-9:
            out.append((round(c[0], 6), round(c[1], 6)))
    return out or ring


def union(a, b) -> tuple[Ring, bool]:
    """The union's largest ring, and whether it is a single part without holes."""
    from .raster import fill_holes, label

    xs, ys, (p, q) = compressed(a, b)
    both = p | q
    return ring_of(both, xs, ys), label(both)[1] == 1 and bool((fill_holes(both) == both).all())


def covers(a, b) -> bool:
    _, _, (p, q) = compressed(a, b)
    return not (q & ~p).any()


def minus(ring, others: list, margin: float) -> tuple[Ring, float]:
    """The largest ring of what is left outside the others (each grown by the margin), and the area cut."""
    boxes = [r for o in others for r in grown_boxes(o, margin)]
    xs, ys, masks = compressed(ring, *boxes)
    cut = np.logical_or.reduce(masks[1:]) if boxes else np.zeros_like(masks[0])
    size = np.diff(xs)[:, None] * np.diff(ys)[None, :]
    return ring_of(masks[0] & ~cut, xs, ys), float(size[masks[0] & cut].sum())


def grown_boxes(ring, margin: float) -> list[Ring]:
    """Rectangles that together are the rectilinear ring grown by the margin."""
    xs, ys, (m,) = compressed(ring)
    out = []
    for j in range(m.shape[1]):
        for a, b in runs(m[:, j]):
            out.append([(xs[a] - margin, ys[j] - margin), (xs[b] + margin, ys[j] - margin), (xs[b] + margin, ys[j + 1] + margin), (xs[a] - margin, ys[j + 1] + margin)])
    return out


def runs(line: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], line.astype(int), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def different(xy: np.ndarray) -> np.ndarray:
    """The different points, in order (as np.unique by rows, but faster)."""
    xy = xy[np.lexsort((xy[:, 1], xy[:, 0]))]
    new = np.ones(len(xy), bool)
    new[1:] = (xy[1:] != xy[:-1]).any(1)
    return xy[new]


def inradius(ring, steps: int = 24) -> float:
    """Radius of the largest circle inside, by refining a grid about the best places so far."""
    r = np.asarray(ring, float).reshape(-1, 2)
    if len(r) < 3 or area(r) <= 0:
        return 0.0
    lo, hi = r.min(0), r.max(0)
    span, centres, best = (hi - lo) / 2, np.array([(lo + hi) / 2]), 0.0
    offsets = np.stack(np.meshgrid(*[np.linspace(-1, 1, 13)] * 2), -1).reshape(-1, 2)
    for _ in range(steps):
        at = different((centres[:, None] + offsets[None] * span).reshape(-1, 2).round(9))
        inside = contains(r, at)
        if inside.any():
            at = at[inside]
            d = distance(r, at)
            best = max(best, float(d.max()))
            centres = at[np.argsort(-d, kind="stable")[:6]]
        span = span * 0.55
    return best


def resampled(ring, step: float = 0.1, least: int = 8) -> np.ndarray:
    """Points at equal distances along a ring: max(least, length // step) of them, from its first corner."""
    e = edges_of(ring)
    size = np.hypot(e[:, 2] - e[:, 0], e[:, 3] - e[:, 1])
    end = np.cumsum(size)
    n = max(least, int(end[-1] / step))
    at = np.arange(n) * end[-1] / n
    k = np.minimum(np.searchsorted(end, at, "right"), len(e) - 1)
    t = (at - end[k] + size[k]) / np.maximum(size[k], 1e-300)
    return e[k, :2] + t[:, None] * (e[k, 2:] - e[k, :2])


def placed(ring, transform) -> np.ndarray:
    x, y, th = transform
    r, c, s = np.asarray(ring, float).reshape(-1, 2), np.cos(th), np.sin(th)
    return np.stack([x + c * r[:, 0] - s * r[:, 1], y + s * r[:, 0] + c * r[:, 1]], 1)
