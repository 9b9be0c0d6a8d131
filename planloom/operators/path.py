"""The ordered camera path: steps, travel, ends, sampling, crossings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def segments(path: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Consecutive pairs (x, z) -> (x1, z1) of each path."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return path.withColumn("x1", F.lead("x").over(w)).withColumn("z1", F.lead("z").over(w)).where("x1 is not null")


def travel(path: DataFrame, keys: list[str], order: list[str], unit: float = 1e-6) -> DataFrame:
    """Length of each path, summed in whole units so that the order of summation doesn't matter."""
    s = segments(path, keys, order)
    step = F.sqrt((F.col("x1") - F.col("x")) * (F.col("x1") - F.col("x")) + (F.col("z1") - F.col("z")) * (F.col("z1") - F.col("z")))
    return s.groupBy(*keys).agg(F.sum(F.floor(step / unit + 0.5).cast("long")).alias("travel_units"), F.count("*").alias("steps"))


def endpoints(path: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    o = F.struct(*order)
    return path.groupBy(*keys).agg(
        F.min_by("x", o).alias("x_first"), F.min_by("z", o).alias("z_first"), F.max_by("x", o).alias("x_last"), F.max_by("z", o).alias("z_last")
    )


def every(path: DataFrame, keys: list[str], order: list[str], step) -> DataFrame:
    """Every step-th row of each path, the first one included. step: a column of the count `_n`, or a number."""
    w = Window.partitionBy(*keys)
    out = path.withColumn("_n", F.count("*").over(w)).withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1)
    step = step(F.col("_n")) if callable(step) else F.lit(step)
    return out.where(F.col("_i") % step == 0).drop("_n", "_i")


def cap_step(cap: int):
    """Layer cap: ceil(n / cap)."""
    return lambda n: F.greatest(F.lit(1), F.ceil(n / F.lit(cap)).cast("long"))


def thin_step(about: int):
    """Path thinning: n // about, at least 1 (so up to 2 about - 1 rows stay)."""
    return lambda n: F.greatest(F.lit(1), F.floor(n / F.lit(about)).cast("long"))


def sampled_frames(frames: DataFrame, keys: list[str], index: str, stride: int, most: int) -> DataFrame:
    """Frames whose index is a multiple of the stride, the first `most` of each capture."""
    w = Window.partitionBy(*keys).orderBy(index)
    return frames.where(F.col(index) % stride == 0).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def first_rows(df: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """The first `most` rows of each key; every task keeps so many at most before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def crossing(s, offset):
    """Where a segment that strictly changes sides of x = offset crosses it (null if it doesn't)."""
    d0, d1 = s("x") - offset, s("x1") - offset
    t = d0 / (d0 - d1)
    return F.when(d0 * d1 < 0, s("z") + t * (s("z1") - s("z")))
