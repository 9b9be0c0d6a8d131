"""Captures of a single room: outline and region labels of many captures in one job, and a drawing."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import outline
from ..operators import rules
from .captures import plain
from .plan import Drawing

REGION = "cells int, u double, v double, run double, height double, inset double, side string, within boolean, area double"


def outlined(points: DataFrame, camera: DataFrame, levels: DataFrame, samples: int = 200, seed: int = 0) -> DataFrame:
    """(capture_id, doc): outline.fit() of each capture as JSON. points: capture_id, x, y, z, a voxelised
    cloud of one room; camera: capture_id, seq, x, y, z; levels: capture_id, floor_y, ceil_y."""
    rows = lambda df, seq: df.select("capture_id", seq.cast("long").alias("seq"), "x", "y", "z")
    both = rows(points, F.lit(None)).unionByName(rows(camera, F.col("seq"))).join(levels.select("capture_id", "floor_y", "ceil_y"), "capture_id")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        path = part["seq"].notna()
        cloud = part[~path].sort_values(["x", "y", "z"])[["x", "y", "z"]].to_numpy(float)
        walk = part[path].sort_values("seq")[["x", "y", "z"]].to_numpy(float)
        ceil = part["ceil_y"].iloc[0]
        got = outline.fit(cloud, walk, float(part["floor_y"].iloc[0]), None if pd.isna(ceil) else float(ceil), samples, seed)
        return pd.DataFrame({"capture_id": [part["capture_id"].iloc[0]], "doc": [json.dumps(plain(got), sort_keys=True)]})

    return both.groupBy("capture_id").applyInPandas(run, "capture_id string, doc string")


def regions(outlines: DataFrame) -> DataFrame:
    """A row per region of outlined(), with its label and the rule that gave it."""
    kind = "array<struct<" + ", ".join(x.replace(" ", ": ") for x in REGION.split(", ")) + ">>"
    r = outlines.select("capture_id", F.posexplode(F.from_json(F.get_json_object("doc", "$.regions"), kind)).alias("k", "r")).select("capture_id", "k", "r.*")
    label, rule = rules.region_label(F.col("within"), F.col("inset"), F.col("run"), F.col("height"))
    return r.select("*", label.alias("label"), rule.alias("rule"))


#: Fill by label.
FILLS = {"wall": "#333", "low_furniture": "#9c6", "tall_furniture": "#693", "suspected_occluder": "#c63", "noise_or_ghost": "#bbb"}


def outline_svg(doc: dict, labelled: list[dict] | None = None) -> str:
    """The outline, its corners (hollow where inferred) and the regions' centres by label."""
    ring = np.array(doc.get("ring") or [], float).reshape(-1, 2)
    c, s = np.cos(np.radians(doc.get("angle", 0.0))), np.sin(np.radians(doc.get("angle", 0.0)))
    world = lambda u, v: (u * c - v * s, u * s + v * c)
    marks = [(world(r["u"], r["v"]), FILLS.get(r["label"], "#000")) for r in labelled or []]
    d = Drawing([*ring.tolist(), *(m for m, _ in marks)])
    for a, b in zip(ring, np.roll(ring, -1, 0), strict=True):
        d.line(a, b, "#111", 3)
    for k in doc.get("corners", []):
        d.dots([world(k["u"], k["v"])], "#111" if k["provenance"] == "observed" else "#fff", 4)
    for at, fill in marks:
        d.dots([at], fill, 5)
    return d.svg("outline")
