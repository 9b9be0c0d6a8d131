"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b); root is the component's smallest node.

    Each round links every node's larger neighbours, then its smaller ones, to its smallest
    neighbour; the number of rounds grows with the logarithm of the component size. Minima are
    aggregated before the shuffle and written before the join, so a node with very many neighbours is
    no hot key in the one and can be split by adaptive execution in the other. Rounds end in the shared folder, so a lost
    executor costs at most one round.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        linked = both.where("b > a") if large else both
        out = linked.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def digest(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = digest(now)
    while True:
        now = written(star(star(now, True), False))
        this = digest(now)
        if this == last:
            break
        last = this
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
