"""Damage rules, scope, provenance and plan checks as predicates over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Provenance in order of preference when lengths tie.
PROVENANCE = ("observed", "inferred_extension", "inferred_occluded", "inferred_dropout")
#: Class, flag, measured column, threshold.
CONCEALED = [
    ("water_stain", "MOIST", "area", 0.30),
    ("mold", "MOIST", "area", 0.30),
    ("crack", "STRUCT", "length", 1.00),
    ("mold", "BIO", "area", 0.50),
]
#: Class, task, unit.
SCOPE = [
    ("water_stain", "dry_and_repaint", "m2"),
    ("mold", "remediate_mold", "m2"),
    ("crack", "fill_crack", "m"),
    ("peeling_paint", "scrape_and_repaint", "m2"),
]


def damage_class(lum: Column, sat: Column, red_minus_blue: Column, gradient: Column) -> Column:
    """First rule that holds; null where none does."""
    return (
        F.when((lum < 95) & (sat < 0.40), "mold")
        .when((red_minus_blue > 18) & (lum < 205), "water_stain")
        .when(gradient > 45, "crack")
        .when(gradient > 30, "peeling_paint")
    )


def region_gate(kind: Column, cells: Column, area: Column, length: Column, aspect: Column) -> Column:
    return (cells >= 6) & F.when(kind == "crack", (length >= 0.30) & (aspect >= 2.5)).otherwise(area >= 0.02)


def concealed_flags(damages: DataFrame) -> DataFrame:
    """A row per damage(kind, area, length) and flag that its class and size raise; several may."""
    spark: SparkSession = damages.sparkSession
    rules = spark.createDataFrame(CONCEALED, "kind string, flag string, measured string, least double")
    joined = damages.join(F.broadcast(rules), "kind")  # four rules
    value = F.when(F.col("measured") == "length", F.col("length")).otherwise(F.col("area"))
    return joined.where(value > F.col("least"))


def scope_items(damages: DataFrame, rel: float = 0.25) -> DataFrame:
    """Task, unit and quantity with its interval for each damage; quantities of zero or less are dropped."""
    tasks = damages.sparkSession.createDataFrame(SCOPE, "kind string, task string, unit string")
    q = F.when(F.col("unit") == "m", F.col("length")).otherwise(F.col("area"))
    out = damages.join(F.broadcast(tasks), "kind").withColumn("quantity", q).where("quantity > 0")  # four tasks
    return out.withColumn("low", F.col("quantity") * (1 - rel)).withColumn("high", F.col("quantity") * (1 + rel))


def dominant_provenance(pieces: DataFrame, keys: list[str], length: str = "length", provenance: str = "provenance") -> DataFrame:
    """The provenance with the largest total length, by order of preference on ties."""
    rank = F.coalesce(*[F.when(F.col(provenance) == p, F.lit(-i)) for i, p in enumerate(PROVENANCE)], F.lit(-len(PROVENANCE)))
    total = pieces.groupBy(*keys, provenance).agg(F.sum(length).alias("total"))
    top = total.groupBy(*keys).agg(F.max(F.struct("total", rank.alias("r"), provenance)).alias("_t"))
    return top.select(*keys, F.col(f"_t.{provenance}").alias(provenance), F.col("_t.total").alias("total"))


def region_label(within: Column, inset: Column, run: Column, height: Column, long: float = 1.2, low: float = 1.0, far: tuple[float, float] = (0.3, 0.7)) -> tuple[Column, Column]:
    """What a region of cells in a single room is, and why: the first rule that holds, by how far it lies
    from the nearest wall line, how long it runs and how high it reaches."""
    # Labels and the names of their rules.
    cases = [
        (~within, "noise_or_ghost", "beyond_nearest_wall_line"),
        ((inset <= 0.10) & (run >= long), "wall", "long_run_aligned_to_manhattan"),
        (inset <= 0.10, "tall_furniture", "run_below_min_run"),
        (inset.between(*far) & (run >= long), "suspected_occluder", "long_flat_inset_from_wall_line"),
        (height <= low, "low_furniture", "only_below_furniture_height"),
        (run < long, "tall_furniture", "run_below_min_run"),
    ]
    label, rule = F.lit("noise_or_ghost"), F.lit("unexplained_region")
    for holds, name, why in reversed(cases):
        label, rule = F.when(holds, name).otherwise(label), F.when(holds, why).otherwise(rule)
    return label, rule


def weighted_offset(pieces: DataFrame, keys: list[str], offset: str = "offset", length: str = "length") -> DataFrame:
    """The length-weighted mean offset of each cluster of pieces, their number and total length."""
    out = pieces.groupBy(*keys).agg(F.sum(F.col(offset) * F.col(length)).alias("_s"), F.count("*").alias("pieces"), F.sum(length).alias("length"))
    return out.select(*keys, (F.col("_s") / F.col("length")).alias("offset"), "pieces", "length")


def missing_parent(child: DataFrame, column: str, parent: DataFrame, parent_key: str, child_key: str, what: str) -> DataFrame:
    """Rows of a child table whose non-null reference has no parent, with a message."""
    found = child.where(F.col(column).isNotNull()).join(parent.select(F.col(parent_key).alias(column)), column, "left_anti")
    return found.select(F.lit(what).alias("check"), F.col(child_key).cast("string").alias("id"), F.format_string(f"{what}: %s refers to unknown %s", F.col(child_key).cast("string"), F.col(column).cast("string")).alias("message"))


def violations(df: DataFrame, name: str, holds: Column, key: str) -> DataFrame:
    """Rows for which a constraint is false or unknown."""
    return df.where(~F.coalesce(holds, F.lit(False))).select(F.lit(name).alias("check"), F.col(key).cast("string").alias("id"))
