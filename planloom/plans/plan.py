"""The plan of a capture: surfaces and openings from rooms, the JSON document, and drawings."""

from __future__ import annotations

import json
import math
from html import escape

import numpy as np

from .. import schemas


def to_world(uv, angle_deg: float) -> tuple[float, float]:
    c, s = math.cos(math.radians(angle_deg)), math.sin(math.radians(angle_deg))
    return round(uv[0] * c - uv[1] * s, 4), round(uv[0] * s + uv[1] * c, 4)


def ends(w: dict, angle: float) -> tuple[tuple[float, float], tuple[float, float]]:
    pick = (lambda t: (w["offset"], t)) if w["axis"] == 0 else (lambda t: (t, w["offset"]))
    return to_world(pick(w["start"]), angle), to_world(pick(w["end"]), angle)


def surfaces(rooms: list[dict], angle: float) -> list[dict]:
    """A wall surface per wall length, its plane's normal toward the room's centre."""
    out = []
    for r in rooms:
        centre = np.mean([to_world(c, angle) for c in r["ring"]], 0)
        for k, w in enumerate(r["wall_lengths"], 1):
            a, b = (np.array(x) for x in ends(w, angle))
            n = np.array([-(b - a)[1], (b - a)[0]]) / max(float(np.hypot(*(b - a))), 1e-12)
            n = -n if n @ (centre - a) < 0 else n
            out.append({"id": f"{r['id']}_wall_{k}", "room_id": r["id"], "type": "wall", "a": a.tolist(), "b": b.tolist(), "nx": float(n[0]), "nz": float(n[1]), "d": float(-n @ a)})
    return out


def measure(name: str, kind: str, value: float, low: float, high: float, method: str, tier: str = "lidar") -> dict:
    return {"id": name, "kind": kind, "value": round(value, 4), "unit": "m2" if "area" in kind else "m", "ci_low": round(min(low, value), 4), "ci_high": round(max(high, value), 4), "method": method, "tier": tier}


def segment_distance(p, a, b) -> float:
    p, a, b = (np.asarray(x, float) for x in (p, a, b))
    n = float((b - a) @ (b - a))
    t = min(1.0, max(0.0, float((p - a) @ (b - a)) / n)) if n > 1e-12 else 0.0
    return float(np.hypot(*(p - a - t * (b - a))))


def connector_openings(found: list[dict], walls: list[dict], rooms: list[dict], angle: float) -> list[dict]:
    """Two openings, one a room, per opening between two rooms; each on its room's nearest wall."""
    height, out = {r["id"]: r["ceiling"]["value"] for r in rooms}, []
    for o in found:
        if not o["rooms"]:
            continue
        mid = np.mean(ends(o, angle), 0)
        for side, room in zip("ab", o["rooms"], strict=True):
            mine = [w for w in walls if w["room_id"] == room]
            if mine:
                host = min(mine, key=lambda w: segment_distance(mid, w["a"], w["b"]))
                name, w, h = f"{o['id']}_{side}", o["width"], height.get(room, 2.4)
                out.append({"id": name, "room_id": room, "surface_id": host["id"], "kind": o["kind"], "width": measure(f"{name}.width", "opening_width", w, w * 0.9, w * 1.1, "camera_path_cross"), "height": measure(f"{name}.height", "opening_height", h, h * 0.95, h * 1.05, "prior")})
    return out


def door_rows(found: list[dict], walls: list[dict], rooms: list[dict], angle: float) -> list[dict]:
    """The connector openings as the stitcher takes them: room, kind, width, half, and the middle and
    inward normal on the wall that holds each."""
    by_id = {w["id"]: w for w in walls}
    mids = {o["id"]: np.mean(ends(o, angle), 0).tolist() for o in found}
    out = []
    for o in connector_openings(found, walls, rooms, angle):
        host, w = by_id[o["surface_id"]], o["width"]
        out.append({"room": o["room_id"], "kind": o["kind"], "width": w["value"], "half": (w["ci_high"] - w["ci_low"]) / 2, "mid": mids[o["id"][:-2]], "normal": [host["nx"], host["nz"]]})
    return out


def document(capture_id: str, walls_json: str, rooms_json: str, stitch_doc: dict | None = None, damages: dict[str, list[dict]] | None = None) -> dict:
    """The plan document. Without rooms its status says so and its lists are empty."""
    found, plan = json.loads(walls_json), json.loads(rooms_json)
    angle, rs = found["angle"], plan["rooms"]
    s = surfaces(rs, angle)
    rooms = [
        {
            "capture_id": capture_id, "id": r["id"], "ring": [list(to_world(c, angle)) for c in r["ring"]], "area": measure(f"{r['id']}.area", "floor_area", r["area"], *r["area_ci"], "monte_carlo"),
            "ceiling": measure(f"{r['id']}.ceiling", "ceiling_height", r["ceiling"]["value"], r["ceiling"]["ci_low"], r["ceiling"]["ci_high"], r["ceiling"]["method"]), "observed": r["observed"], "perimeter": r["perimeter"],
        }
        for r in rs
    ]
    doc = {"status": "computed" if rs else "not_computed", "capture_id": capture_id, "rooms": rooms, "surfaces": [{"capture_id": capture_id} | x for x in s], "openings": [{"capture_id": capture_id} | x for x in connector_openings(plan["openings"], s, rs, angle)]}
    return dropped_nulls(doc | {"stitch": stitch_doc} | (damages or {}))


def dropped_nulls(x):
    if isinstance(x, dict):
        return {k: dropped_nulls(v) for k, v in x.items() if v is not None}
    return [dropped_nulls(v) for v in x] if isinstance(x, list) else x


def problems(doc: dict) -> list[str]:
    """Everything wrong with a plan document: unknown fields, wrong types, broken references, intervals
    that do not hold their value. Types come first; the rest is only looked at if they are right."""
    out = []
    for name, table in schemas.TABLES.items():
        shape = schemas.json_schema(table)
        for k, row in enumerate(doc.get(name, [])):
            out += mismatches(row, shape, f"{name}[{k}]")
    if out:
        return out
    for child, column, parent in schemas.REFERENCES:
        known = {r["id"] for r in doc.get(parent, [])}
        out += [f"{child} refers to unknown {parent} {r[column]}" for r in doc.get(child, []) if r.get(column) is not None and r[column] not in known]
    for (name, column), allowed in schemas.ENUMS.items():
        out += [f"{name}.{column}: {r[column]} is not allowed" for r in doc.get(name, []) if r.get(column) not in (None, *allowed)]
    for name in doc:
        for row in doc[name] if isinstance(doc[name], list) else []:
            for field, m in row.items():
                if isinstance(m, dict) and {"value", "ci_low", "ci_high"} <= m.keys() and not m["ci_low"] <= m["value"] <= m["ci_high"]:
                    out.append(f"{name}.{field}: the interval of {m['id']} doesn't hold its value")
    return out


def mismatches(x, shape: dict, where: str) -> list[str]:
    kinds = shape["type"] if isinstance(shape["type"], list) else [shape["type"]]
    fits = {"object": dict, "array": list, "string": str, "boolean": bool, "number": (int, float), "integer": int, "null": type(None)}
    if x is None:
        return []
    if not any(isinstance(x, fits[k]) and not (isinstance(x, bool) and k != "boolean") for k in kinds):
        return [f"{where}: not {' or '.join(kinds)}"]
    if isinstance(x, dict) and "properties" in shape:
        out = [f"{where}.{k}: unknown field" for k in x if k not in shape["properties"]]
        return out + [m for k, v in x.items() if k in shape["properties"] for m in mismatches(v, shape["properties"][k], f"{where}.{k}")]
    return [m for k, v in enumerate(x) for m in mismatches(v, shape["items"], f"{where}[{k}]")] if isinstance(x, list) and "items" in shape else []


# ---- drawings --------------------------------------------------------------------------------

#: Stroke by provenance.
STROKES = {"observed": "#111", "inferred_extension": "#06c", "inferred_occluded": "#a60", "inferred_dropout": "#999", "inferred_closure": "#c0c"}


class Drawing:
    """World coordinates in metres on an SVG page; z grows upward on paper."""

    def __init__(self, points, scale: float = 80.0, margin: float = 0.5):
        p = np.asarray(points, float).reshape(-1, 2) if len(points) else np.zeros((1, 2))
        self.lo, self.hi, self.scale, self.margin, self.parts = p.min(0), p.max(0), scale, margin, []

    def xy(self, p) -> tuple[float, float]:
        return round((p[0] - self.lo[0] + self.margin) * self.scale, 2), round((self.hi[1] - p[1] + self.margin) * self.scale, 2)

    def line(self, a, b, stroke: str, width: float = 2.0, dash: str = "") -> None:
        (x0, y0), (x1, y1) = self.xy(a), self.xy(b)
        self.parts.append(f'<line x1="{x0}" y1="{y0}" x2="{x1}" y2="{y1}" stroke="{stroke}" stroke-width="{width}"' + (f' stroke-dasharray="{dash}"' if dash else "") + "/>")

    def ring(self, points, fill: str) -> None:
        self.parts.append(f'<polygon points="{" ".join("{},{}".format(*self.xy(p)) for p in points)}" fill="{fill}" stroke="none"/>')

    def dots(self, points, fill: str, size: float = 1.0) -> None:
        self.parts += ['<circle cx="{}" cy="{}" r="{}" fill="{}"/>'.format(*self.xy(p), size, fill) for p in points]

    def text(self, at, content: str) -> None:
        x, y = self.xy(at)
        self.parts.append(f'<text x="{x}" y="{y}" font-size="12" text-anchor="middle">{escape(content)}</text>')

    def svg(self, title: str) -> str:
        w, h = ((self.hi - self.lo) + 2 * self.margin) * self.scale
        return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {w:.1f} {h:.1f}"><title>{escape(title)}</title>{"".join(self.parts)}</svg>\n'


def evidence_svg(wall, floor, path) -> str:
    d = Drawing([*wall, *floor, *path])
    d.dots(floor, "#dde", 2)
    d.dots(wall, "#333")
    for a, b in zip(path, path[1:], strict=False):
        d.line(a, b, "#c33", 1)
    return d.svg("evidence")


def walls_svg(found: dict) -> str:
    """Walls clipped to the outermost graph nodes on their lines, openings dashed."""
    angle = found["angle"]
    d = Drawing([p for w in [*found["walls"], *found["opening"]] for p in ends(w, angle)])
    for w in found["walls"]:
        d.line(*ends(clipped(w, found["graph"]["nodes"]), angle), STROKES.get(w["provenance"], "#111"), 3)
    for w in found["opening"]:
        d.line(*ends(w, angle), "#0a0", 2, "6 4")
    return d.svg("walls")


def clipped(w: dict, nodes: list[dict], tol: float = 0.15) -> dict:
    across, along = ("u", "v") if w["axis"] == 0 else ("v", "u")
    on = [n[along] for n in nodes if abs(n[across] - w["offset"]) <= tol]
    return w | {"start": max(w["start"], min(on)), "end": min(w["end"], max(on))} if on and max(on) > min(on) else w


#: Stroke by damage class.
DAMAGE_STROKES = {"mold": "#063", "water_stain": "#c80", "crack": "#c00", "peeling_paint": "#808"}


def plan_svg(doc: dict, found: dict, plan: dict, rectangles: list[dict] | None = None) -> str:
    """Rooms, walls by provenance, openings, and damage as thick strokes along its walls."""
    marks = rectangles or []
    d = Drawing([*(c for r in doc["rooms"] for c in r["ring"]), *((m[f"x{k}"], m[f"z{k}"]) for m in marks for k in (0, 1))])
    for r in doc["rooms"]:
        d.ring(r["ring"], "#eef")
        d.text(np.mean(r["ring"], 0), f"{r['id']} {r['area']['value']:.2f} m2")
    for r in plan["rooms"]:
        for w in r["wall_lengths"]:
            d.line(*ends(w, found["angle"]), STROKES.get(w["provenance"], "#111"), 3)
    for o in plan["openings"]:
        d.line(*ends(o, found["angle"]), "#0a0", 4, "6 4")
    for m in marks:
        d.line((m["x0"], m["z0"]), (m["x1"], m["z1"]), DAMAGE_STROKES.get(m["kind"], "#f00"), 6)
    return d.svg(doc["capture_id"])


def ablation_svg(rings: dict[str, list], on: dict[str, tuple], off: dict[str, tuple]) -> str:
    """The rooms placed with and without loop closure, side by side."""
    from ..kernels import polygons

    left = [polygons.placed(r, on[k]) for k, r in rings.items()]
    right = [polygons.placed(r, off[k]) for k, r in rings.items()]
    shift = np.array([max(p[:, 0].max() for p in left) - min(p[:, 0].min() for p in right) + 1.0, 0.0]) if left else np.zeros(2)
    right = [p + shift for p in right]
    d = Drawing(np.concatenate([*left, *right]) if left else [])
    for p in left + right:
        d.ring(p, "#aac8")
    return d.svg("loop closure on, off")
