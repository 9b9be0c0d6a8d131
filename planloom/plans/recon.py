"""Depth pixels and poses to a voxelised world cloud, with its quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spatial
from ..operators import grid


def world_points(depth: DataFrame, frames: DataFrame, scale: float = 0.001, max_range: float = 8.0, least_confidence: int = 1, gates: bool = True, sx: float = 1.0, sy: float = 1.0) -> DataFrame:
    """capture_id, idx, pid and world x, y, z of the pixels that pass the gates. depth: pixels
    (capture_id, name, u, v, depth, confidence); frames: read_frames(). sx, sy scale the intrinsics to
    the depth grid. pid follows frame and pixel order."""
    metres = F.col("depth") * scale
    p = depth.withColumn("metres", metres).where("metres > 0")
    if gates:
        p = p.where((F.col("metres") <= max_range) & (F.col("confidence") >= least_confidence))
    f = frames.select("capture_id", F.col("frame").alias("name"), "idx", "x", "y", "z", "qx", "qy", "qz", "qw", "fx", "fy", "cx", "cy")
    j = p.join(f, ["capture_id", "name"])
    fx, fy, cx, cy = spatial.scale_intrinsics(*(F.col(c) for c in ("fx", "fy", "cx", "cy")), F.lit(sx), F.lit(sy))
    cam = spatial.back_project(F.col("u"), F.col("v"), F.col("metres"), fx, fy, cx, cy)
    rows = spatial.quaternion_rows(*(F.col(c) for c in ("qx", "qy", "qz", "qw")))
    world = spatial.to_world(rows, [F.col(c) for c in "xyz"], cam)
    pid = F.col("idx").cast("long") * (1 << 32) + F.col("v").cast("long") * (1 << 16) + F.col("u")
    return j.select("capture_id", "idx", pid.alias("pid"), *[w.alias(n) for w, n in zip(world, "xyz", strict=True)], F.col("metres").alias("depth_m"))


def poses(frames: DataFrame) -> DataFrame:
    """capture_id, idx and the 4 x 4 camera-to-world matrix m of each frame, row by row."""
    rows = spatial.quaternion_rows(*(F.col(c) for c in ("qx", "qy", "qz", "qw")))
    return frames.select("capture_id", "idx", spatial.pose(rows, [F.col(c) for c in "xyz"]).alias("m"))


def voxelised(points: DataFrame, size: float = 0.01) -> DataFrame:
    """The first point by pid of each voxel."""
    v = points.select("*", *[grid.cell(c, size).alias(f"v{c}") for c in "xyz"])
    return grid.voxel_first(v, ["capture_id"], ["vx", "vy", "vz"], ["pid"], ["idx", "x", "y", "z"]).drop("vx", "vy", "vz")


def quality(depth: DataFrame, points: DataFrame, slab: float = 0.05) -> DataFrame:
    """Share of pixels with depth, spread of the heights near the lowest two percent, frames used."""
    cov = depth.groupBy("capture_id").agg(F.avg((F.col("depth") > 0).cast("double")).alias("coverage"), F.count_distinct("name").alias("track_len"))
    low = points.groupBy("capture_id").agg(F.percentile("y", 0.02).alias("low"))
    rms = points.join(low, "capture_id").where(F.abs(F.col("y") - F.col("low")) <= slab).groupBy("capture_id").agg(F.stddev_pop("y").alias("plane_rms"))
    return cov.join(rms, "capture_id", "left")


def frame_stride(frames: DataFrame, stride: int) -> DataFrame:
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("capture_id").orderBy("timestamp", "frame")) - 1
    return frames.withColumn("_k", k).where(F.col("_k") % stride == 0).drop("_k")
