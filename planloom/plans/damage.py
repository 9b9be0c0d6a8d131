"""Damage from coloured wall surfaces: assignment of points, grids, classes, regions and follow-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spatial
from ..operators import components, grid, rules

CELL, BAND_LOW, TOLERANCE, LEAST = 0.05, 0.20, 0.08, 3


def usable_walls(surfaces: DataFrame) -> DataFrame:
    """Walls with two ends and an upright plane."""
    return surfaces.where((F.col("type") == "wall") & (F.size("a") >= 2) & (F.size("b") >= 2) & F.col("d").isNotNull() & F.col("nx").isNotNull())


def assigned(points: DataFrame, surfaces: DataFrame, floor_y: float = 0.0, top: float = 2.20) -> DataFrame:
    """Coloured points on the nearest wall plane within tolerance, inside its span and the height band;
    the first surface by id on ties. A capture has tens of walls, so its points meet all of them."""
    s = usable_walls(surfaces).select("capture_id", F.col("id").alias("surface_id"), "a", "b", "nx", "nz", "d")
    j = points.where((F.col("y") - floor_y >= BAND_LOW) & (F.col("y") - floor_y <= top)).join(s, "capture_id")
    dist = F.abs(F.col("nx") * F.col("x") + F.col("nz") * F.col("z") + F.col("d"))
    dx, dz = F.col("b")[0] - F.col("a")[0], F.col("b")[1] - F.col("a")[1]
    size = F.hypot(dx, dz)
    along = ((F.col("x") - F.col("a")[0]) * dx + (F.col("z") - F.col("a")[1]) * dz) / size
    j = j.withColumn("dist", dist).withColumn("along", along).where((F.col("dist") < TOLERANCE) & (F.col("along") >= 0) & (F.col("along") < size))
    best = j.groupBy("capture_id", "pid").agg(F.min(F.struct("dist", "surface_id", "along", "y", "r", "g", "b2")).alias("m"))
    return best.select("capture_id", "pid", "m.surface_id", "m.along", "m.y", "m.r", "m.g", F.col("m.b2").alias("b"))


def coloured(points: DataFrame, rgb: DataFrame, levels: DataFrame, nearest: float = 0.30) -> DataFrame:
    """World points of the sampled frames with their pixels' colours, heights above the floor. points:
    recon.world_points(), whose pid holds frame, row and column; rgb: video.pixels() of frames as
    large as the depth images. Points nearer to the camera than `nearest` don't count."""
    p = points.select("capture_id", "pid", "idx", F.expr("cast(pid & 65535 as int)").alias("u"), F.expr("cast(shiftright(pid, 16) & 65535 as int)").alias("v"), "x", "y", "z", "depth_m").where(F.col("depth_m") >= nearest)
    j = p.join(rgb, ["capture_id", "idx", "u", "v"]).join(levels.select("capture_id", "floor_y"), "capture_id")
    return j.select("capture_id", "pid", "x", (F.col("y") - F.col("floor_y")).alias("y"), "z", "r", "g", "b2")


def surface_grid(on: DataFrame, floor_y: float = 0.0) -> DataFrame:
    """Mean colour per surface cell; null under three samples."""
    cells = on.select("capture_id", "surface_id", grid.cell(F.col("y") - floor_y - BAND_LOW, CELL).alias("i"), grid.cell("along", CELL).alias("j"), "r", "g", "b")
    s = cells.groupBy("capture_id", "surface_id", "i", "j").agg(*[F.sum(c).alias(f"sum_{c}") for c in "rgb"], F.count("*").alias("n"))
    return s.select("*", *[F.when(F.col("n") >= LEAST, F.col(f"sum_{c}") / F.col("n")).alias(c) for c in "rgb"])


def regions(cells: DataFrame, size: float = CELL) -> DataFrame:
    """Damage regions of surface grids (capture_id, surface_id, i, j, r, g, b) with ids, extents and boxes."""
    keys = ["capture_id", "surface_id"]
    m = cells.where("r is not null")
    m = m.withColumn("lum", spatial.luminance(F.col("r"), F.col("g"), F.col("b"))).withColumn("sat", spatial.saturation(F.col("r"), F.col("g"), F.col("b")))
    m = m.join(grid.max_step(m, keys, "lum"), [*keys, "i", "j"])
    m = m.withColumn("kind", rules.damage_class(F.col("lum"), F.col("sat"), F.col("r") - F.col("b"), F.col("gradient"))).where("kind is not null")
    lab = components.label_cells(m.select(*keys, "i", "j", "kind"), keys, diagonal=True, value=["kind"])
    s = components.component_stats(lab, [*keys, "kind"], size)
    s = s.where(rules.region_gate(F.col("kind"), F.col("cells"), F.col("area"), F.col("length"), F.col("aspect")))
    k = F.row_number().over(Window.partitionBy(*keys, "kind").orderBy("li", "lj"))
    return s.withColumn("id", F.format_string("dmg_%s_%s_%02d", "surface_id", "kind", k))


def rectangles(found: DataFrame, surfaces: DataFrame, size: float = CELL) -> DataFrame:
    """World segments and heights of the regions' boxes on their walls."""
    s = surfaces.select("capture_id", F.col("id").alias("surface_id"), "a", "b")
    j = found.join(s, ["capture_id", "surface_id"])
    dx, dz = F.col("b")[0] - F.col("a")[0], F.col("b")[1] - F.col("a")[1]
    n = F.hypot(dx, dz)
    at = lambda k: [(F.col("a")[0] + dx / n * k * size), (F.col("a")[1] + dz / n * k * size)]
    (x0, z0), (x1, z1) = at(F.col("j0")), at(F.col("j1") + 1)
    return j.select("capture_id", "id", "kind", x0.alias("x0"), z0.alias("z0"), x1.alias("x1"), z1.alias("z1"), (F.col("i0") * size + BAND_LOW).alias("low"), ((F.col("i1") + 1) * size + BAND_LOW).alias("high"))


def assessed(cells: DataFrame) -> dict[str, DataFrame]:
    """damages, concealed flags, scope items and counts by class."""
    d = regions(cells)
    flags = rules.concealed_flags(d).select("capture_id", "surface_id", "id", "flag")
    scope = rules.scope_items(d).select("capture_id", "surface_id", "id", "task", "unit", "quantity", "low", "high")
    return {"damages": d, "concealed": flags, "scope": scope, "counts": d.groupBy("capture_id", "kind").agg(F.count("*").alias("n"))}
