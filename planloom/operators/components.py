"""Connected components of cells: rows are cut to runs in Spark; runs are joined band by band."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written


def find_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each of n nodes' component, by label spreading with pointer jumping."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, root[a], root[b])
        np.minimum.at(low, root[b], root[a])
        low = low[low]
        low = low[low]
        if (low == root).all():
            return root
        root = low


BAND = 256  # raster rows that one call of the kernel labels


def label_cells(cells: DataFrame, keys: list[str], diagonal: bool = False, value: list[str] | None = None, band: int = BAND) -> DataFrame:
    """(keys, value, i, j, li, lj) of distinct cells(keys, i, j[, value]): the least cell (li, lj) of each
    one's 4- or 8-connected component (of cells with equal value).

    Rows are cut to runs, runs are joined by a kernel, and the labelled runs are unfolded again. With
    keys, a raster is bounded by the room of its capture, and one call joins its runs. Without, it may
    have any size: a call takes `band` rows of it, and then the labels that meet at a border of two
    bands are joined, so only what touches a border comes together.
    """
    keyed = bool(keys)
    by = [*keys, *(value or [])]
    w = Window.partitionBy(*by, "i").orderBy("j")
    new = F.coalesce((F.col("j") - F.lag("j").over(w) > 1).cast("int"), F.lit(1))
    marked = cells.select(*by, "i", "j").withColumn("_r", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy(*by, "i", "_r").agg(F.min("j").alias("a"), F.max("j").alias("b")).drop("_r")
    runs = runs.select(*by, F.col("i").cast("long").alias("i"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    runs = runs.withColumn("_band", F.lit(0).cast("long") if keyed else F.floor(F.col("i") / band).cast("long"))
    reach = 1 if diagonal else 0
    tile = [*by, "_band"]

    def join_runs(part: pd.DataFrame) -> pd.DataFrame:
        group = part.groupby(tile, dropna=False, sort=False).ngroup().to_numpy()
        part = part.assign(_g=group).sort_values(["_g", "i", "a"], ignore_index=True)
        i, a, b = (part[c].to_numpy() for c in ("i", "a", "b"))
        # rows of one tile after the other, with a free one between two tiles
        row = part["_g"].to_numpy() * (i.max() - i.min() + 2) + i - i.min()
        wide = b.max() - a.min() + 4
        place, end = row * wide + a - a.min() + 1, row * wide + b - a.min() + 1
        # in the next row: the first run that ends late enough, up to the last that starts early enough
        lo = np.searchsorted(end, place + wide - reach)
        hi = np.searchsorted(place, end + wide + reach, "right")
        n = np.maximum(hi - lo, 0)
        left = np.repeat(np.arange(len(part)), n)
        right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        root = find_roots(len(part), left, right)
        return part.drop(columns="_g").assign(li=i[root], lj=a[root])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema) + ", li long, lj long"
    # several small tiles share a call of the kernel; one tile is never split
    buckets = 4 * int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.xxhash64(*tile), F.lit(buckets))
    labelled = runs.withColumn("_b", bucket).groupBy("_b").applyInPandas(lambda part: join_runs(part.drop(columns="_b")), schema)
    unfolded = lambda df: df.select(*by, "i", F.explode(F.sequence("a", "b")).alias("j"), "li", "lj")
    if keyed:
        return unfolded(labelled)

    # labels that touch across a border, as edges; a raster of one band has none
    labelled = written(labelled)
    upper = labelled.where((F.col("i") + 1) % band == 0).select(*[F.col(c).alias(f"_{c}") for c in by], (F.col("i") + 1).alias("_i"), F.col("a").alias("_a"), F.col("b").alias("_e"), F.col("li").alias("pi"), F.col("lj").alias("pj"))
    lower = labelled.where(F.col("i") % band == 0).select(*by, "i", "a", "b", F.col("li").alias("qi"), F.col("lj").alias("qj"))
    touch = (F.col("_i") == F.col("i")) & (F.col("a") <= F.col("_e") + reach) & (F.col("b") >= F.col("_a") - reach)
    for c in by:
        touch = touch & F.col(f"_{c}").eqNullSafe(F.col(c))
    edges = upper.join(lower, touch).select(*by, "pi", "pj", "qi", "qj").distinct().withColumn("_g", F.lit(0))

    def join_labels(part: pd.DataFrame) -> pd.DataFrame:
        ends = [x for c in "pq" for x in zip(part[f"{c}i"].tolist(), part[f"{c}j"].tolist(), strict=True)]
        names = sorted(set(ends))
        at = {x: k for k, x in enumerate(names)}
        n = len(part)
        root = find_roots(len(names), *(np.array([at[x] for x in ends[lo : lo + n]]) for lo in (0, n)))
        known = {c: part[c].iloc[0] for c in by}
        return pd.DataFrame({**{c: [known[c]] * len(names) for c in by}, "li": [x[0] for x in names], "lj": [x[1] for x in names], "_i": [names[k][0] for k in root], "_j": [names[k][1] for k in root]})

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in runs.schema if f.name in by)
    moved = edges.groupBy(*by or ["_g"]).applyInPandas(join_labels, f"{kept}li long, lj long, _i long, _j long")
    moved = moved.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("li").alias("_li"), F.col("lj").alias("_lj"), "_i", "_j")
    on = (F.col("li") == F.col("_li")) & (F.col("lj") == F.col("_lj"))
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    whole = labelled.join(moved, on, "left").select(*by, "i", "a", "b", F.coalesce("_i", "li").alias("li"), F.coalesce("_j", "lj").alias("lj"))
    return unfolded(whole)


def component_stats(labelled: DataFrame, keys: list[str], size: float = 1.0) -> DataFrame:
    """Cells, box, area, length and aspect of each component."""
    out = labelled.groupBy(*keys, "li", "lj").agg(
        F.count("*").alias("cells"), F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("j").alias("j0"), F.max("j").alias("j1")
    )
    h, w = F.col("i1") - F.col("i0") + 1, F.col("j1") - F.col("j0") + 1
    return out.withColumn("area", F.col("cells") * size * size).withColumn("length", F.greatest(h, w) * size).withColumn("aspect", F.greatest(h, w) / F.least(h, w))
