"""Whole captures from bundle to plan: one plan of DataFrames over all the captures of a folder or
glob, each step written once to the shared folder where several later ones read it."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import params, schemas
from .operators import path
from .plans import captures, damage, evidence, plan, recon
from .shared import written
from .sources import bundle, stages, video


@dataclass
class Run:
    """The tables of a run. docs has a row a capture with all that its files are made of."""

    frames: DataFrame
    points: DataFrame | None
    levels: DataFrame
    camera: DataFrame
    quality: DataFrame | None
    docs: DataFrame


def depth_pixels(spark: SparkSession, folder: str) -> DataFrame:
    depth = bundle.pixels(bundle.decoded(bundle.file_names(spark, folder, "depth")), "depth")
    sure = bundle.pixels(bundle.decoded(bundle.file_names(spark, folder, "confidence")), "confidence")
    return bundle.with_confidence(depth, sure)


def levels_of(points: DataFrame) -> DataFrame:
    """planes(); where a cloud has none, the height that two percent of it lie under is the floor."""
    low = points.groupBy("capture_id").agg(F.percentile("y", 0.02).alias("low"))
    j = low.join(evidence.planes(points), "capture_id", "left")
    return j.select("capture_id", F.coalesce("floor_y", "low").alias("floor_y"), "ceil_y", F.col("floor_y").isNull().alias("guessed"))


def surfaces(done: DataFrame) -> DataFrame:
    """The wall surfaces of the rooms, a row each (schemas.TABLES['surfaces'])."""

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [{"capture_id": c} | s for c, w, r in part[["capture_id", "walls", "rooms"]].itertuples(index=False) for s in plan.surfaces(json.loads(r)["rooms"], json.loads(w)["angle"])]
            yield pd.DataFrame(rows, columns=[f.name for f in schemas.TABLES["surfaces"]])

    return done.select("capture_id", "walls", "rooms").mapInPandas(run, schemas.TABLES["surfaces"])


def stitch_inputs(done: DataFrame) -> DataFrame:
    """captures.stitched()'s documents: the rooms' rings in the world, and their doors."""

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for c, w, r in part[["capture_id", "walls", "rooms"]].itertuples(index=False):
                found, rooms = json.loads(w), json.loads(r)
                angle = found["angle"]
                rings = {x["id"]: [list(plan.to_world(p, angle)) for p in x["ring"]] for x in rooms["rooms"]}
                doors = plan.door_rows(rooms["openings"], plan.surfaces(rooms["rooms"], angle), rooms["rooms"], angle)
                out.append((c, json.dumps({"rooms": rings, "openings": doors})))
            yield pd.DataFrame(out, columns=["capture_id", "doc"])

    return done.select("capture_id", "walls", "rooms").mapInPandas(run, "capture_id string, doc string")


def surface_evidence(spark: SparkSession, folder: str, frames: DataFrame, levels: DataFrame, walls: DataFrame, cfg: params.Config, rgb: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The colour grids of the wall surfaces from sampled frames, and per capture how many frames were
    sampled and had colours, and how many points lie on a wall."""
    chosen = path.sampled_frames(frames.where("idx is not null"), ["capture_id"], "idx", cfg.damage_stride, cfg.damage_frames)
    rgb = video.read(spark, folder, cfg.damage_stride) if rgb is None else rgb
    seen = recon.world_points(depth_pixels(spark, folder), chosen, cfg.depth_scale, cfg.damage_farthest, cfg.least_confidence)
    on = written(damage.assigned(damage.coloured(seen, video.pixels(rgb), levels, cfg.damage_nearest), walls))
    count = lambda df, name: df.groupBy("capture_id").agg(F.count("*").alias(name))
    info = count(chosen, "frames_sampled").join(count(rgb.join(chosen.select("capture_id", "idx"), ["capture_id", "idx"], "left_semi"), "frames_with_rgb"), "capture_id", "left").join(count(on, "points_projected"), "capture_id", "left")
    return damage.surface_grid(on), info.na.fill(0)


def as_lists(tables: dict[str, DataFrame], name: str) -> DataFrame:
    """(capture_id, name): the rows of several tables as one JSON document of lists."""
    out = None
    for kind, df in tables.items():
        rows = df.select("capture_id", F.struct(F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "true"}).alias("row")).alias("r"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("capture_id").agg(F.to_json(F.array_sort(F.collect_list("r"))).alias(name))


def lists_of(doc: str | None, *kinds: str) -> dict[str, list[dict]]:
    rows = json.loads(doc or "[]")
    return {k: [json.loads(r["row"]) for r in rows if r["kind"] == k] for k in kinds}


def finished(spark: SparkSession, folder: str | None, cfg: params.Config, done: DataFrame, evidence_docs: DataFrame, frames: DataFrame | None, levels: DataFrame, rgb: DataFrame | None) -> DataFrame:
    """done with the evidence, the stitched rooms, the damage and its grids' statistics, a row a capture."""
    stitched = captures.stitched(stitch_inputs(done))
    both = stitched.groupBy("capture_id").agg(F.to_json(F.collect_list(F.struct(*[c for c in stitched.columns if c != "capture_id"]))).alias("stitch"))
    out = done.join(evidence_docs.withColumnRenamed("doc", "evidence"), "capture_id", "left").join(both, "capture_id", "left")
    if not cfg.damage or frames is None:
        return out.withColumn("damage", F.lit(None).cast("string")).withColumn("sampling", F.lit(None).cast("string"))
    walls = written(surfaces(done))
    cells, info = surface_evidence(spark, folder, frames, levels, walls, cfg, rgb)
    found = written(damage.regions(written(cells)))
    from .operators import rules

    flags = rules.concealed_flags(found).select("capture_id", "surface_id", "flag").distinct()
    scope = rules.scope_items(found).select("capture_id", "id", "surface_id", "task", "quantity", "low", "high")
    tables = {"damages": found.select("capture_id", "id", "surface_id", "kind", "area", "length"), "concealed": flags, "scope": scope, "rectangles": damage.rectangles(found, walls)}
    sampling = info.select("capture_id", F.to_json(F.struct("frames_sampled", "frames_with_rgb", "points_projected")).alias("sampling"))
    return out.join(as_lists(tables, "damage"), "capture_id", "left").join(sampling, "capture_id", "left")


def run(spark: SparkSession, folder: str, cfg: params.Config, rgb: DataFrame | None = None) -> Run:
    """All steps over the bundles of a folder or glob. rgb: decoded frames (video.SCHEMA), where there
    is no decoder for the videos."""
    every = written(bundle.read_frames(spark, folder))
    frames = recon.frame_stride(every, cfg.stride)
    depth = depth_pixels(spark, folder)
    world = lambda gates: recon.voxelised(recon.world_points(depth, frames, cfg.depth_scale, cfg.max_range, cfg.least_confidence, gates), cfg.voxel)
    points = written(world(True))
    levels = written(levels_of(points))
    camera = frames.select("capture_id", F.col("idx").alias("seq"), "x", "y", "z")
    layers = {k: written(v) for k, v in evidence.layers(points, camera, levels).items()}
    docs = stages.evidence_documents(layers, camera, levels, evidence.statistics(layers, camera))
    high = points.join(levels, "capture_id").where(F.col("y") > F.col("floor_y") + 2.0).select("capture_id", "x", "y", "z")
    done = written(captures.reconstructed(captures.stacked(layers, camera, high), levels, cfg.least_support, cfg.walls, cfg.rooms))
    out = finished(spark, folder, cfg, done, docs, every, levels, rgb)
    clouds = stages.npz(points, "points", ["x", "y", "z"], ["pid"]).withColumnRenamed("content", "points_npz")
    if cfg.save_unfiltered:
        clouds = clouds.join(stages.npz(world(False), "points", ["x", "y", "z"], ["pid"]).withColumnRenamed("content", "unfiltered_npz"), "capture_id", "left")
    cells = [f"m{k}" for k in range(16)]
    poses = recon.poses(every).select("capture_id", "idx", *[F.col("m")[k].alias(c) for k, c in enumerate(cells)])
    clouds = clouds.join(stages.npz(poses, "poses", cells, ["idx"], "float64").withColumnRenamed("content", "poses_npz"), "capture_id", "full")
    return Run(every, points, levels, camera, recon.quality(depth, points), out.join(clouds, "capture_id", "left"))


def resumed(spark: SparkSession, out: str, cfg: params.Config, walls: bool = False) -> Run:
    """Goes on from what earlier runs saved below `out`: the evidence and the cloud, and with `walls` the walls too."""
    layers, camera, levels = stages.read_evidence(spark, f"{out}/*/evidence.json")
    points = stages.read_npz(spark, f"{out}/*/recon/points.npz", "points", ["x", "y", "z"])
    high = points.join(levels, "capture_id").where(F.col("y") > F.col("floor_y") + 2.0).select("capture_id", "x", "y", "z")
    saved = stages.documents(spark, f"{out}/*/walls.json") if walls else None
    done = written(captures.reconstructed(captures.stacked(layers, camera, high), levels, cfg.least_support, cfg.walls, cfg.rooms, saved))
    docs = stages.documents(spark, f"{out}/*/evidence.json")
    return Run(camera, points, levels, camera, None, finished(spark, None, cfg, done, docs, None, levels, None))


#: What decides a damage region, a flag or a scope item, as the report names it.
THRESHOLDS = {"cell": damage.CELL, "band_low": damage.BAND_LOW, "tolerance": damage.TOLERANCE, "least_samples": damage.LEAST, "mold": "lum < 95 and sat < 0.40", "water_stain": "r - b > 18 and lum < 205", "crack": "gradient > 45, length >= 0.30, aspect >= 2.5", "peeling_paint": "gradient > 30", "least_cells": 6, "least_area": 0.02}


def files_of(row: dict, cfg: params.Config, tier: str = "lidar") -> tuple[dict[str, bytes | str], list[str], list[str]]:
    """The files of one capture, everything wrong with its plan, and its failed invariants. An invalid
    plan has no plan.json."""
    from .operators import rules

    found, rooms, invariants = (json.loads(row[k]) for k in ("walls", "rooms", "invariants"))
    both = {s["loop_closure"]: s for s in json.loads(row.get("stitch") or "[]")}
    chosen = both.get(cfg.loop_closure)
    numbers = lambda s: {k: s.get(k) for k in ("footprint", "closure_gap")} if s else None
    stitch = chosen and {"poses": json.loads(chosen["poses"]), "overlap_ok": chosen["overlap_ok"], "unstitched": chosen["unstitched"], "ablation": {"on": numbers(both.get(True)), "off": numbers(both.get(False))}}
    hurt = lists_of(row.get("damage"), "damages", "concealed", "scope", "rectangles")
    tables = {k: hurt[k] for k in ("damages", "concealed", "scope")}
    doc = plan.document(row["capture_id"], row["walls"], row["rooms"], stitch, tables) | {"provenance": params.provenance(tier, cfg.seed)}
    sampling = json.loads(row.get("sampling") or "{}")
    warnings = [] if sampling.get("points_projected") else ["no coloured points on wall surfaces"]
    report = {
        "thresholds": THRESHOLDS, "evidence": sampling, "damage_count": len(hurt["damages"]), "by_class": {k: sum(d["kind"] == k for d in hurt["damages"]) for k in sorted({d["kind"] for d in hurt["damages"]})},
        "concealed_count": len(hurt["concealed"]), "scope_count": len(hurt["scope"]), "scope_map": {k: {"task": t, "unit": u} for k, t, u in rules.SCOPE}, "rules": [list(x) for x in rules.CONCEALED], "warnings": warnings,
    }
    pretty = lambda x: json.dumps(x, indent=2, sort_keys=True) + "\n"
    layers = json.loads(row["evidence"]) if row.get("evidence") else {}
    cells = layers.get("wall_cells") or {"x": [], "z": []}
    out: dict[str, bytes | str] = {
        "walls.json": pretty(found), "rooms.json": pretty(rooms | {"invariants": invariants}), "damage.json": pretty(report), "walls.svg": plan.walls_svg(found), "plan.svg": plan.plan_svg(doc, found, rooms, hurt["rectangles"]),
    }
    if layers:
        out["evidence.json"] = pretty(layers)
        out["evidence.svg"] = plan.evidence_svg(list(zip(cells["x"], cells["z"], strict=True)), layers.get("floor_cells") or [], layers.get("camera_path") or [])
    rings = {r["id"]: r["ring"] for r in doc["rooms"]}
    if len(both) == 2:
        out["ablation.svg"] = plan.ablation_svg(rings, *(json.loads(both[k]["poses"]) for k in (True, False)))
    for name, key in (("points", "points_npz"), ("points_unfiltered", "unfiltered_npz"), ("poses", "poses_npz")):
        if row.get(key) is not None:
            out[f"recon/{name}.npz"] = bytes(row[key])
    wrong = plan.problems(doc)
    if not wrong:
        out["plan.json"] = pretty(doc)
    return out, wrong, [i["name"] for i in invariants if i["ok"] is False]
