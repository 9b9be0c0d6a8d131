"""Polygons as rows of corners."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ring_edges(corners: DataFrame, keys: list[str], order: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Each corner with the next one (x1, y1), the last with the first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return corners.withColumn("x1", F.coalesce(F.lead(x).over(w), F.first(x).over(whole))).withColumn("y1", F.coalesce(F.lead(y).over(w), F.first(y).over(whole)))


def shoelace(corners: DataFrame, keys: list[str], order: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Twice the area (exact for whole coordinates); 0 under three corners."""
    e = ring_edges(corners, keys, order, x, y)
    cross = F.col(x) * F.col("y1") - F.col("x1") * F.col(y)
    return e.groupBy(*keys).agg(F.when(F.count("*") >= 3, F.abs(F.sum(cross))).otherwise(0).alias("area2"), F.count("*").alias("corners"))


def inside(points: DataFrame, edges: DataFrame, on: list[str], point_key: list[str], px: str = "px", py: str = "py", x: str = "x", y: str = "y") -> DataFrame:
    """Ray casting with half-open edges: the points whose ray crosses an odd number of the edges of the
    polygon with equal `on` columns.

    Where an edge crosses a height depends on the height alone. So if many points share their heights,
    a polygon's crossings are found once a height, and a point's are those that sort behind it there:
    no pair of a point and an edge is made."""
    up = (F.col(y) > F.col(py)) != (F.col("y1") > F.col(py))
    at = F.col(x) + (F.col(py) - F.col(y)) / (F.col("y1") - F.col(y)) * (F.col("x1") - F.col(x))
    line = points.select(*on, py)
    n = line.agg(F.count("*").alias("all"), F.count_distinct(F.struct(*on, py)).alias("lines")).first()
    if 4 * n["lines"] > n["all"]:
        hit = F.when(up, F.when(F.col(px) < at, 1).otherwise(0)).otherwise(0)
        each = points.join(edges, on).withColumn("_n", hit)
    else:
        met = line.distinct().join(edges.select(*on, x, y, "x1", "y1"), on).where(up).select(*on, py, at.alias("_x")).where("_x is not null")
        asked = points.join(edges.select(*on).distinct(), on, "left_semi").select(*on, py, F.col(px).cast("double").alias("_x"), F.lit(0).alias("_o"), *point_key)
        none = [F.lit(None).cast(points.schema[k].dataType).alias(k) for k in point_key]
        rows = asked.unionByName(met.withColumn("_o", F.lit(1)).select(*on, py, F.col("_x").cast("double").alias("_x"), "_o", *none))
        behind = Window.partitionBy(*on, py).orderBy(F.desc("_x"), "_o").rowsBetween(Window.unboundedPreceding, 0)
        each = rows.withColumn("_n", F.when(F.isnull("_x"), 0).otherwise(F.sum("_o").over(behind))).where("_o = 0")
    return each.groupBy(*point_key, *on).agg(F.sum("_n").alias("crossings")).withColumn("inside", F.col("crossings") % 2 == 1)
