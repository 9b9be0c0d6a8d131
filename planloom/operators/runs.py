"""Gaps and islands, and sweeps over intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(bins: DataFrame, keys: list[str], gap: int, bin_col: str = "bin") -> DataFrame:
    """Runs of occupied bins: a new run begins where the index grows by more than `gap`. The bins must
    be distinct. Gives run (from 1), first, last, occupied and length in bins."""
    w = Window.partitionBy(*keys).orderBy(bin_col)
    step = F.col(bin_col) - F.lag(bin_col).over(w)
    marked = bins.withColumn("run", F.sum(F.when(step.isNull() | (step > gap), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = marked.groupBy(*keys, "run").agg(F.min(bin_col).alias("first"), F.max(bin_col).alias("last"), F.count("*").alias("occupied"))
    return out.withColumn("length", F.col("last") - F.col("first") + 1)


def coverage(runs: DataFrame) -> DataFrame:
    return runs.withColumn("coverage", F.col("occupied") / F.col("length"))


def longest(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The longest run of each key, the first on ties."""
    top = runs.groupBy(*keys).agg(F.max(F.struct("length", (-F.col("first")).alias("f"), "last")).alias("_t"))
    return top.select(*keys, (-F.col("_t.f")).alias("first"), F.col("_t.last").alias("last"), F.col("_t.length").alias("length"))


def reach_gaps(intervals: DataFrame, line: list[str], least: float, tie: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Gaps on a line between how far the intervals so far reach and where the next one starts."""
    w = Window.partitionBy(*line).orderBy(start, end, *tie).rowsBetween(Window.unboundedPreceding, -1)
    swept = intervals.withColumn("g0", F.max(end).over(w)).withColumn("g1", F.col(start))
    return swept.where(F.col("g1") - F.col("g0") > least).select(*line, "g0", "g1")


def classify_gap(crossed: Column, occluders: Column, width: Column, open_min: float, open_max: float, dropout_max: float, least: int) -> tuple[Column, Column]:
    """Kind and rule of a gap: what the camera crossed is open unless too narrow, what furniture hides
    or is short is bridged, anything else stays unknown."""
    kind = (
        F.when(crossed & (width < open_min), "inferred_dropout")
        .when(crossed & (width > open_max), "open_space")
        .when(crossed, "opening")
        .when(occluders >= least, "inferred_occluded")
        .when(width <= dropout_max, "inferred_dropout")
        .otherwise("unknown")
    )
    rule = (
        F.when(crossed & (width < open_min), "crossed_gap_below_open_min")
        .when(crossed & (width > open_max), "camera_crossed_wide_gap")
        .when(crossed, "camera_path_crosses_gap")
        .when(occluders >= least, "furniture_in_front_of_gap")
        .when(width <= dropout_max, "short_gap")
        .otherwise("long_gap_no_evidence")
    )
    return kind, rule


def waists(profile: DataFrame, keys: list[str], low: int, high: int, around: int, wide: int, index: str = "bin", width: str = "n") -> DataFrame:
    """Strict local minima of a dense width profile that lie in low..high, are the least within
    `around` places on both sides, with a width of `wide` at least in that window. Beyond an end the
    width is 0, so a minimum near an end is none."""
    w = Window.partitionBy(*keys).orderBy(index)
    left, right = F.coalesce(F.lag(width).over(w), F.lit(0)), F.coalesce(F.lead(width).over(w), F.lit(0))
    frame = w.rowsBetween(-around, around)
    whole = F.count("*").over(frame) == 2 * around + 1
    least = F.when(whole, F.min(width).over(frame)).otherwise(0)
    v = F.col(width)
    rule = (v < left) & (v < right) & v.between(low, high) & (v == least) & (F.max(width).over(frame) >= wide)
    return profile.withColumn("is_waist", rule)
