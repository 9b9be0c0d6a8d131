"""Histograms on a dense axis, smoothing and peaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edge_bin(value: Column, low: Column, high: Column, width: float) -> Column:
    """The bin of a value among edges low, low + d, low + 2d, ... where d is (low + width) - low, as
    computed edges fall; the last edge belongs to the last bin."""
    d = (low + F.lit(width)) - low
    i = F.floor((value - low) / d)
    i = F.when(value < low + i * d, i - 1).when(value >= low + (i + 1) * d, i + 1).otherwise(i)
    last = F.ceil((high - low) / d) - 1
    return F.least(i, last).cast("long")


def dense_counts(binned: DataFrame, keys: list[str], bin_col: str = "bin") -> DataFrame:
    """Counts of every bin between the first and the last, the empty ones with 0."""
    counts = binned.groupBy(*keys, bin_col).agg(F.count("*").alias("n"))
    ends = counts.groupBy(*keys).agg(F.min(bin_col).alias("_a"), F.max(bin_col).alias("_b"))
    spine = ends.select(*keys, F.explode(F.sequence("_a", "_b")).alias(bin_col))
    return spine.join(counts, [*keys, bin_col], "left").select(*keys, bin_col, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def smoothed(hist: DataFrame, keys: list[str], size: int = 5, bin_col: str = "bin", n: str = "n") -> DataFrame:
    """Centred moving average that always divides by `size`. The axis must be dense."""
    half = size // 2
    w = Window.partitionBy(*keys).orderBy(bin_col).rowsBetween(-half, half)
    return hist.withColumn("smooth", F.sum(n).over(w) / F.lit(float(size)))


def peaks(hist: DataFrame, keys: list[str], ends: str, value: str = "smooth", bin_col: str = "bin") -> DataFrame:
    """Adds is_peak. ends: 'interior' (greater than the right, not less than the left, positive, not
    at an end), 'zero' (not less than both, a missing neighbour being 0) or 'open' (not less than both,
    a missing neighbour never being greater)."""
    w = Window.partitionBy(*keys).orderBy(bin_col)
    v, left, right = F.col(value), F.lag(value).over(w), F.lead(value).over(w)
    if ends == "interior":
        rule = F.coalesce((v >= left) & (v > right) & (v > 0), F.lit(False))
    elif ends == "zero":
        rule = (v >= F.coalesce(left, F.lit(0.0))) & (v >= F.coalesce(right, F.lit(0.0))) & (v > 0)
    else:
        rule = F.coalesce(v >= left, F.lit(True)) & F.coalesce(v >= right, F.lit(True))
    return hist.withColumn("is_peak", rule)


def two_planes(peaked: DataFrame, keys: list[str], apart: int, bin_col: str = "bin", value: str = "smooth") -> DataFrame:
    """Of the peaks the highest, and the highest at least `apart` bins from it (the lower bin on ties)."""
    top = F.max(F.struct(F.col(value).alias("v"), (-F.col(bin_col)).alias("b")))
    p = peaked.where("is_peak")
    first = p.groupBy(*keys).agg(top.alias("_t")).select(*keys, (-F.col("_t.b")).alias("first"))
    rest = p.join(first, keys) if keys else p.crossJoin(F.broadcast(first))  # one row
    second = rest.where(F.abs(F.col(bin_col) - F.col("first")) >= apart).groupBy(*keys).agg(top.alias("_t")).select(*keys, (-F.col("_t.b")).alias(bin_col), F.lit(2).alias("rank"))
    return first.select(*keys, F.col("first").alias(bin_col), F.lit(1).alias("rank")).unionByName(second)


def angle_scores(points: DataFrame, keys: list[str], table: DataFrame, size: float) -> DataFrame:
    """Per angle of table(angle, c, s) the sum over both rotated axes of squared bin counts. Equal
    points are counted first; then each place meets every angle of the table, whose rows are fixed."""
    places = points.groupBy(*keys, "x", "z").agg(F.count("*").alias("_w"))
    both = places.crossJoin(F.broadcast(table))
    u, v = F.col("x") * F.col("c") + F.col("z") * F.col("s"), -F.col("x") * F.col("s") + F.col("z") * F.col("c")
    axis = F.explode(F.array(F.struct(F.lit(0).alias("axis"), u.alias("w")), F.struct(F.lit(1).alias("axis"), v.alias("w"))))
    binned = both.select(*keys, "angle", "_w", axis.alias("_a")).select(*keys, "angle", "_w", "_a.axis", F.floor(F.col("_a.w") / size).cast("long").alias("bin"))
    counts = binned.groupBy(*keys, "angle", "axis", "bin").agg(F.sum("_w").alias("n"))
    return counts.groupBy(*keys, "angle").agg(F.sum(F.col("n") * F.col("n")).alias("score"))


def best_angle(scores: DataFrame, keys: list[str]) -> DataFrame:
    """The angle with the largest score, the smallest such angle."""
    top = scores.groupBy(*keys).agg(F.max(F.struct("score", (-F.col("angle")).alias("a"))).alias("_t"))
    return top.select(*keys, (-F.col("_t.a")).alias("angle"), F.col("_t.score").alias("score"))
