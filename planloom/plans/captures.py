"""The per-capture kernels over many captures: walls, rooms, stitching and invariants in one pass each."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import polygons, rooms, stitch, walls
from .plan import document

NO_ROOMS = {"rooms": [], "enclosed": [], "fragments": [], "closures": [], "plan_score": 0.0, "waists": [], "merges": [], "openings": [], "adjacency": [], "overlaps": []}

STAGE = "capture_id string, layer string, x double, z double, y double, support long, seq long"


def stacked(layers: dict[str, DataFrame], camera: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """The rows of a capture's layers in one table, so that one grouping brings them together. Cells are
    bounded by the room that was walked; of the cloud only what lies above head height is needed."""

    def rows(df, layer, y=None, support=None, seq=None):
        pick = lambda c, t: (F.col(c) if c else F.lit(None)).cast(t)
        return df.select("capture_id", F.lit(layer).alias("layer"), "x", "z", pick(y, "double").alias("y"), pick(support, "long").alias("support"), pick(seq, "long").alias("seq"))

    out = rows(layers["wall_cells"], "wall", support="support").unionByName(rows(layers["floor_cells"], "floor")).unionByName(rows(layers["free_cells"], "free")).unionByName(rows(camera, "path", seq="seq"))
    return out.unionByName(rows(points, "high", y="y")) if points is not None else out


def arrays(part: pd.DataFrame) -> dict[str, np.ndarray]:
    out = {}
    for layer in ("wall", "floor", "free", "path", "high"):
        p = part[part.layer == layer].sort_values(["seq", "x", "z", "y"])
        out[layer] = p[["x", "z"]].to_numpy(float).reshape(-1, 2)
        out[f"{layer}_support"], out[f"{layer}_y"] = p["support"].fillna(0).to_numpy(), p["y"].to_numpy(float)
    return out


def plain(x):
    """JSON-ready: numpy scalars and arrays as Python values."""
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return x.tolist() if isinstance(x, (np.ndarray, np.generic)) else x


RECONSTRUCTED = "capture_id string, walls string, rooms string, invariants string, plan string"


def reconstructed(rows: DataFrame, floors: DataFrame, least_support: int = 4, wall_params: dict | None = None, room_params: dict | None = None, saved: DataFrame | None = None) -> DataFrame:
    """capture_id, and walls, rooms, invariants and the plain plan document as JSON. rows: stacked();
    floors: capture_id, floor_y, ceil_y. saved: walls (capture_id, doc) of an earlier run, which are
    taken instead of reconstructing them."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        a = arrays(part)
        again = part["doc"].dropna().head(1).tolist() if "doc" in part else []
        found = json.loads(again[0]) if again else walls.reconstruct(a["wall"], a["wall_support"], a["path"], least_support, wall_params)
        turn = lambda xz: walls.rotated(xz, found["angle"])
        nodes = np.array([(n["u"], n["v"]) for n in found["graph"]["nodes"]]).reshape(-1, 2)
        # the walls that rooms are built from carry no intervals of their own
        bare = [walls.wall(w["axis"], w["offset"], w["start"], w["end"], provenance=w["provenance"], support=w["support"]) for w in found["walls"]]
        floor_y = float(part["floor_y"].iloc[0]) if part["floor_y"].notna().any() else 0.0
        ceil_y = float(part["ceil_y"].iloc[0]) if part["ceil_y"].notna().any() else None
        empty = not len(a["wall"]) and not len(a["floor"])
        plan = dict(NO_ROOMS) if empty else rooms.build(bare, found["opening"], nodes, turn(a["wall"]), turn(a["floor"]), turn(a["path"]), turn(a["free"]), turn(a["high"]), a["high_y"], floor_y, ceil_y, room_params)
        held = invariants(found, plan, turn(a["free"]), turn(a["path"]), turn(a["high"]), a["high_y"], floor_y)
        name = part["capture_id"].iloc[0]
        docs = [json.dumps(plain(x), sort_keys=True) for x in (found, plan, held)]
        return pd.DataFrame([[name, *docs, json.dumps(document(name, docs[0], docs[1]), sort_keys=True)]], columns=["capture_id", "walls", "rooms", "invariants", "plan"])

    joined = rows.join(floors, "capture_id", "left")
    if saved is not None:
        joined = joined.join(saved.select("capture_id", "doc"), "capture_id", "left")
    return joined.groupBy("capture_id").applyInPandas(run, RECONSTRUCTED)


def near_segment(xy: np.ndarray, gaps: list[dict], within: float) -> np.ndarray:
    out = np.zeros(len(xy), bool)
    for g in gaps:
        out |= walls.distances(xy, g) <= within
    return out


def invariants(found: dict, plan: dict, free: np.ndarray, path: np.ndarray, high: np.ndarray, ys: np.ndarray, floor_y: float, p: dict | None = None) -> list[dict]:
    """Six checks of a plan: name, ok (None: skipped) and values. Without rooms only render_clip runs."""
    p = rooms.PARAMS | {"overlap_tol": 1e-4, "coverage": 0.95, "spread": 0.30} | (p or {})
    rs = plan["rooms"]
    rings = {r["id"]: r["ring"] for r in rs}
    out = []

    def add(name, ok, **values):
        out.append({"name": name, "ok": ok, "values": values})

    def covered(xy):
        every = [*rings.values(), *(e["ring"] for e in plan["enclosed"])]
        return np.logical_or.reduce([polygons.contains(r, xy) | (polygons.distance(r, xy) <= 0.05) for r in every]) if every else np.zeros(len(xy), bool)

    if rs:
        bent = [k for k, r in rings.items() if not polygons.is_simple(r)]
        ids = sorted(rings)
        total = sum(polygons.overlap(rings[a], rings[b]) for i, a in enumerate(ids) for b in ids[i + 1 :])
        add("no_overlap", not bent and total <= p["overlap_tol"], total=round(total, 6), invalid=bent)
        small = [k for k, r in rings.items() if polygons.area(r) < p["room_min_area"] or polygons.inradius(r) < p["room_min_radius"] - 5e-3]
        add("min_room", not small, violations=small)
        if len(free):
            share = float((covered(free) | near_segment(free, plan["openings"], 0.05)).mean())
            add("coverage", share >= p["coverage"], share=round(share, 4))
        else:
            add("coverage", None)
        if len(path):
            ok = covered(path) | near_segment(path, [*plan["openings"], *found["open_space"]], 0.10)
            add("camera_inside", bool(ok.all()), inside=int(ok.sum()), total=len(path), outside=[tuple(np.round(x, 3)) for x in path[~ok][:10]])
        else:
            add("camera_inside", None)
    else:
        for name in ("no_overlap", "min_room", "coverage", "camera_inside"):
            add(name, None)
    nodes = found["graph"]["nodes"]
    if found["walls"] and nodes:
        over = []
        for w in found["walls"]:
            k = "uv"[w["axis"]], "vu"[w["axis"]]
            on = [n[k[1]] for n in nodes if abs(n[k[0]] - w["offset"]) <= walls.PARAMS["collinear"]]
            far = max(0.0, min(on) - w["start"]) + max(0.0, w["end"] - max(on)) if on else walls.length(w)
            if far > p["node_merge"] + 1e-6:
                over.append(round(far, 4))
        add("render_clip", not over, overshoot=over)
    else:
        add("render_clip", None)
    if rs and len(ys):
        bad, heights = [], []
        for r in rs:
            c = r["ceiling"]
            if c["status"] == "measured":
                near = polygons.contains(r["ring"], high) & (np.abs(ys - floor_y - c["value"]) <= 0.05)
                if near.sum() < p["ceiling_cells"] or rooms.footprint(high[near], r["area"]) < p["footprint"] or not p["heights"][0] <= c["value"] <= p["heights"][1]:
                    bad.append(r["id"])
                heights.append(c["value"])
        spread = max(heights) - min(heights) if heights else 0.0
        add("ceiling_sanity", not bad and spread <= p["spread"], violations=bad, spread=round(spread, 4))
    else:
        add("ceiling_sanity", None)
    return out


def connectors(openings: list[dict], width_tol: float = 0.06) -> list[dict]:
    """Pairs of doors or passages of different rooms with like widths, as room-to-room transforms.
    openings: room, kind, width, half, mid (x, y) and normal (x, y) of the wall that holds it."""
    doors, out = [o for o in openings if o["kind"] in ("door", "passage")], []
    for i, a in enumerate(doors):
        for b in doors[i + 1 :]:
            half = a["half"] + b["half"]
            if a["room"] != b["room"] and abs(a["width"] - b["width"]) <= max(width_tol, half):
                theta = float(stitch.wrap(np.arctan2(-b["normal"][1], -b["normal"][0]) - np.arctan2(a["normal"][1], a["normal"][0])))
                c, s = np.cos(theta), np.sin(theta)
                x, y = a["mid"]
                out.append({"a": a["room"], "b": b["room"], "transform": (float(b["mid"][0] - c * x + s * y), float(b["mid"][1] - s * x - c * y), theta), "weight": round(1 / max(half, 0.02), 3)})
    return out


def stitched(plans: DataFrame) -> DataFrame:
    """plans: capture_id, doc (JSON with rooms {id: ring}, openings, start). Each capture is stitched with
    and without loop closure in one job: capture_id, loop_closure, footprint, closure_gap, overlap_ok,
    unstitched and poses as JSON."""
    both = plans.withColumn("loop_closure", F.explode(F.array(F.lit(True), F.lit(False))))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, r in part.iterrows():
            doc = json.loads(r["doc"])
            rings = {k: np.array(v, float) for k, v in doc["rooms"].items()}
            s = stitch.stitch(rings, connectors(doc.get("openings", [])), {k: tuple(v) for k, v in doc.get("start", {}).items()}, bool(r["loop_closure"]))
            if s["unstitched"]:
                placed = {k: polygons.placed(v, s["poses"][k]) for k, v in rings.items()}
                ids = sorted(placed)
                s["unstitched"] = len(stitch.reachable(ids, stitch.touching(placed), ids[0])) < len(ids)
            out.append((r["capture_id"], bool(r["loop_closure"]), s["footprint"], s["closure_gap"], s["overlap_ok"], s["unstitched"], json.dumps(plain(s["poses"]), sort_keys=True)))
        return pd.DataFrame(out, columns=["capture_id", "loop_closure", "footprint", "closure_gap", "overlap_ok", "unstitched", "poses"])

    return both.groupBy("capture_id", "loop_closure").applyInPandas(run, "capture_id string, loop_closure boolean, footprint double, closure_gap double, overlap_ok boolean, unstitched boolean, poses string")
