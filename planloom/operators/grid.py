"""Cells: binning, distinct support, first in a voxel, neighbourhoods and borders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CROSS = ((1, 0), (-1, 0), (0, 1), (0, -1))
SQUARE = tuple((i, j) for i in (-1, 0, 1) for j in (-1, 0, 1))


def cell(value: Column | str, size: float, origin: float = 0.0) -> Column:
    """Index of the bin of `size` that holds the value."""
    v = F.col(value) if isinstance(value, str) else value
    v = v if origin == 0.0 else v - F.lit(origin)
    return F.floor(v if size == 1 else v / F.lit(float(size))).cast("long")


def clipped_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Truncated share of low..high in `bins` bins, the ends taking what lies outside."""
    raw = ((value - low) / (high - low) * bins).cast("long")
    return F.greatest(F.lit(0).cast("long"), F.least(F.lit(bins - 1).cast("long"), raw))


def height_support(points: DataFrame, keys: list[str], cells: list[str], level: str) -> DataFrame:
    """Distinct levels, and points, of each cell. Two-step aggregation, so a crowded cell is no hot key."""
    once = points.groupBy(*keys, *cells, level).agg(F.count("*").alias("_n"))
    return once.groupBy(*keys, *cells).agg(F.count(level).alias("support"), F.sum("_n").alias("n"))


def support_gate(cells: DataFrame, least: int) -> DataFrame:
    return cells.withColumn("kept", F.col("support") >= least)


def voxel_first(points: DataFrame, keys: list[str], voxel: list[str], order: list[str], rest: list[str]) -> DataFrame:
    """The first point of each voxel in the given order. A minimum over structs aggregates partially,
    as a ranking window could not; frame by frame and overall it gives the same point."""
    first = points.groupBy(*keys, *voxel).agg(F.min(F.struct(*order, *rest)).alias("_f"))
    return first.select(*keys, *voxel, *[F.col(f"_f.{c}").alias(c) for c in [*order, *rest]])


def occupied(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()


def shifted(cells: DataFrame, offsets, i: str = "i", j: str = "j", step: str | None = None) -> DataFrame:
    """Each cell once per offset, moved by it."""
    moves = F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in offsets]))
    out = cells.withColumn("_m", moves)
    out = out.withColumn(f"{i}2", F.col(i) + F.col("_m.a")).withColumn(f"{j}2", F.col(j) + F.col("_m.b"))
    return (out.withColumn(step, F.struct("_m.a", "_m.b")) if step else out).drop("_m")


def near(cells: DataFrame, marks: DataFrame, keys: list[str], radius: int = 1, i: str = "i", j: str = "j") -> DataFrame:
    """The cells with a mark at most `radius` away on both axes."""
    span = range(-radius, radius + 1)
    around = shifted(marks.select(*keys, i, j), [(a, b) for a in span for b in span], i, j)
    around = around.select(*keys, F.col(f"{i}2").alias(i), F.col(f"{j}2").alias(j)).distinct()
    return cells.join(around, [*keys, i, j], "left_semi")


def contacts(cells: DataFrame, keys: list[str], region: str, reach: int = 8) -> DataFrame:
    """How often two regions' cells lie 1..reach apart on a row or column, seen from both sides."""
    moves = [(a * k, b * k) for k in range(1, reach + 1) for a, b in CROSS]
    a = shifted(cells, moves).select(*keys, F.col(region).alias("region_a"), F.col("i2").alias("i"), F.col("j2").alias("j"))
    b = cells.select(*keys, "i", "j", F.col(region).alias("region_b"))
    met = a.join(b, [*keys, "i", "j"]).where("region_a <> region_b")
    return met.groupBy(*keys, "region_a", "region_b").agg(F.count("*").alias("contacts"))


def boundary_edges(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The directed unit edges around a set of cells, the set on their left: four shifts, one anti-join."""
    sides = {(0, -1): (0, 0, 1, 0), (1, 0): (1, 0, 1, 1), (0, 1): (1, 1, 0, 1), (-1, 0): (0, 1, 0, 0)}
    moved = shifted(cells.select(*keys, "i", "j"), list(sides), step="side")
    outer = moved.join(cells.select(*keys, F.col("i").alias("i2"), F.col("j").alias("j2")), [*keys, "i2", "j2"], "left_anti")
    corner = lambda k: F.coalesce(*[F.when((F.col("side.a") == a) & (F.col("side.b") == b), F.lit(c[k])) for (a, b), c in sides.items()])
    names = ("i0", "j0", "i1", "j1")
    return outer.select(*keys, *[(F.col("i" if n[0] == "i" else "j") + corner(k)).alias(n) for k, n in enumerate(names)])


def max_step(cells: DataFrame, keys: list[str], value: str, out: str = "gradient") -> DataFrame:
    """Per cell the largest absolute difference of `value` to one of its four neighbours (0 without any)."""
    moved = shifted(cells.select(*keys, "i", "j", value), CROSS).select(*keys, F.col("i2").alias("i"), F.col("j2").alias("j"), F.col(value).alias("_v"))
    step = cells.select(*keys, "i", "j", value).join(moved, [*keys, "i", "j"], "left")
    return step.groupBy(*keys, "i", "j").agg(F.coalesce(F.max(F.abs(F.col(value) - F.col("_v"))), F.lit(0)).alias(out))


def dense_bins(cells: DataFrame, keys: list[str], size: int, least: int) -> DataFrame:
    """Bins of size x size cells with their number of cells, and whether that reaches `least`."""
    binned = cells.select(*keys, cell("i", size).alias("bi"), cell("j", size).alias("bj"))
    return binned.groupBy(*keys, "bi", "bj").agg(F.count("*").alias("cells")).withColumn("dense", F.col("cells") >= least)


def ray_cells(rays: DataFrame, size: float) -> DataFrame:
    """The cells that rays from (x0, z0) to (x1, z1) pass, sampled at int(length / size) + 1 places."""
    dx, dz = F.col("x1") - F.col("x0"), F.col("z1") - F.col("z0")
    n = F.floor(F.sqrt(dx * dx + dz * dz) / size).cast("int")
    r = rays.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(0), n)))
    t = F.col("_k") / F.greatest(F.col("_n"), F.lit(1))
    return r.select(cell(F.col("x0") + t * dx, size).alias("i"), cell(F.col("z0") + t * dz, size).alias("j")).distinct()
