"""Observed evidence of each capture: wall, floor and free cells with their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import grid, hist

BAND_FROM, BAND_TO, BELOW_CEILING, SLAB = 0.25, 1.9, 0.25, 0.08


def planes(points: DataFrame, size: float = 0.01, apart: float = 1.8, factor: float = 2.5, least: float = 0.02) -> DataFrame:
    """capture_id, floor_y and ceil_y (null without one): at most two horizontal planes, from smoothed
    height peaks, the strongest and the strongest far enough from it."""
    keys = ["capture_id"]
    h = hist.smoothed(hist.dense_counts(points.select("capture_id", grid.cell("y", size).alias("bin")), keys), keys)
    typical = h.where("n > 0").groupBy("capture_id").agg(F.median("smooth").alias("typical"))
    p = hist.peaks(h, keys, "zero").join(typical, keys).withColumn("is_peak", F.col("is_peak") & (F.col("smooth") >= factor * F.col("typical")))
    two = hist.two_planes(p, keys, round(apart / size))
    centre = (F.col("bin") + 0.5) * size
    near = points.join(two, keys).where(F.abs(F.col("y") - centre) <= 0.03)
    mean = near.groupBy("capture_id", "rank").agg(F.avg("y").alias("mean"))  # a smoothed peak is a plateau; its points' mean is the plane
    again = points.join(mean, keys).where(F.abs(F.col("y") - F.col("mean")) <= 0.03)
    total = points.groupBy("capture_id").agg(F.count("*").alias("total"))
    s = again.groupBy("capture_id", "rank").agg(F.first("mean").alias("y"), F.count("*").alias("support")).join(total, keys).where(F.col("support") >= least * F.col("total"))
    out = s.groupBy("capture_id").agg(F.min("y").alias("floor_y"), F.max("y").alias("high"))
    return out.select("capture_id", "floor_y", F.when(F.col("high") - F.col("floor_y") >= apart / 2, F.col("high")).alias("ceil_y"))


def layers(points: DataFrame, camera: DataFrame, levels: DataFrame, cell: float = 0.02, bins: int = 10, size: float = 0.10) -> dict[str, DataFrame]:
    """wall_cells (with height support), floor_cells and free_cells; coordinates are cell centres.
    levels: planes() of the captures."""
    p = points.join(levels, "capture_id")
    low, top = F.col("floor_y") + BAND_FROM, F.coalesce(F.col("ceil_y") - BELOW_CEILING, F.col("floor_y") + BAND_TO)
    band = p.where((F.col("y") > low) & (F.col("y") < top)).withColumn("hb", grid.clipped_bin(F.col("y"), low, top, bins))
    band = band.select("capture_id", grid.cell("x", cell).alias("i"), grid.cell("z", cell).alias("j"), "hb")
    centre = lambda c, s: (F.col(c) + 0.5) * s
    walls = grid.height_support(band, ["capture_id"], ["i", "j"], "hb").select("capture_id", centre("i", cell).alias("x"), centre("j", cell).alias("z"), "support")
    slab = p.where(F.abs(F.col("y") - F.col("floor_y")) <= SLAB)
    flat = lambda df: grid.occupied(df.select("capture_id", grid.cell("x", size).alias("i"), grid.cell("z", size).alias("j")), "capture_id", "i", "j").select("capture_id", centre("i", size).alias("x"), centre("j", size).alias("z"))
    return {"wall_cells": walls, "floor_cells": flat(slab), "free_cells": flat(camera)}


def statistics(found: dict[str, DataFrame], camera: DataFrame, size: float = 0.10) -> DataFrame:
    """Counts of the layers and the share of camera positions within a bin of evidence."""
    ij = lambda df: df.select("capture_id", grid.cell("x", size).alias("i"), grid.cell("z", size).alias("j"))
    evidence = ij(found["wall_cells"]).unionByName(ij(found["floor_cells"])).distinct()
    at = ij(camera)
    near = grid.near(at.distinct(), evidence, ["capture_id"]).withColumn("hit", F.lit(1))
    share = at.join(near, ["capture_id", "i", "j"], "left").groupBy("capture_id").agg((F.count("hit") / F.count("*")).alias("camera_inside"))
    for name, df in found.items():
        share = share.join(df.groupBy("capture_id").agg(F.count("*").alias(name)), "capture_id", "left")
    return share.fillna(0, list(found))
