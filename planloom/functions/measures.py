"""Measurements with confidence intervals, identifiers and hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_width(length: Column, observed: Column, ci: Column, odometry: float = 0.01, base: float = 0.03, per_m: float = 0.15) -> Column:
    """Of an observed length the larger of its ci and the odometry's share; of an inferred one a base and a share."""
    return F.when(observed, F.greatest(ci, F.lit(odometry) * length)).otherwise(F.lit(base) + F.lit(per_m) * length)


def relative_measure(value: Column, rel: float) -> Column:
    v = F.greatest(value, F.lit(0.0))
    return F.struct(v.alias("value"), (v * (1 - rel)).alias("ci_low"), (v * (1 + rel)).alias("ci_high"))


def clamped_measure(value: Column, low: Column, high: Column) -> Column:
    return F.struct(value.alias("value"), F.least(low, value).alias("ci_low"), F.greatest(high, value).alias("ci_high"))


def interval_holds(value: Column, low: Column, high: Column) -> Column:
    return (low <= value) & (value <= high)


def rounded_half_even(value: Column, digits: int) -> Column:
    return F.bround(value, digits)


def rounded(value: Column, digits: int) -> Column:
    """Half away from zero of the scaled double, as DuckDB rounds; without the decimal text that Spark's round goes by."""
    scaled = value * F.lit(10.0**digits)
    near = F.rint(scaled)
    tie = F.when(scaled - near == 0.5, F.when(scaled > 0, 1.0).otherwise(0.0)).when(scaled - near == -0.5, F.when(scaled < 0, -1.0).otherwise(0.0)).otherwise(0.0)
    return F.when(F.abs(scaled) < float("inf"), (near + tie) / F.lit(10.0**digits)).otherwise(value)


def content_hash(doc: Column) -> Column:
    """SHA-256 of the compact JSON of a struct whose fields are in name order."""
    return F.sha2(F.to_json(doc), 256)


def escaped_xml(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def depth_scale(unit: Column) -> Column:
    """Factor to millimetres; null for an unknown unit."""
    return F.when(unit == "mm", F.lit(1.0)).when(unit == "m", F.lit(1000.0))


def depth_millimetres(depth: Column, scale: Column) -> Column:
    return F.least(F.greatest(F.rint(depth * scale), F.lit(0.0)), F.lit(65535.0)).cast("int")


def quadrature_half_width(a: Column, b: Column, observed: Column) -> Column:
    """Of a length between two uncertain ends; twice that where it wasn't observed."""
    return F.sqrt(a * a + b * b) * F.when(observed, F.lit(1.0)).otherwise(F.lit(2.0))


def value_or(text: Column, default: float) -> Column:
    """A number from a text column; where it is absent or blank, the default."""
    return F.coalesce(F.nullif(F.trim(text), F.lit("")).cast("double"), F.lit(float(default)))
