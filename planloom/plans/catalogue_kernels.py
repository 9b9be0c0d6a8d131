"""Queries that run the numpy kernels on scenes whose answer has a closed form, so that SQL can say what
must come out: rooms of known size, boxes, rasters, motions and pose graphs, one a row of the driver's tables."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..kernels import polygons, raster, stitch
from . import captures, single
from .catalogue import query, table
from .catalogue_captures import layers, plans, sizes, two_rooms

SIZES = "sizes AS (SELECT 'nation_' || n_nationkey AS capture_id, 3.0::DOUBLE + n_nationkey % 5 * 0.3::DOUBLE AS w, 2.6::DOUBLE + n_regionkey * 0.25::DOUBLE AS h FROM nation)"


# ---- rooms of known size ---------------------------------------------------------------------


@query(f"WITH {SIZES} SELECT capture_id, round(w, 1) AS width, round(h, 1) AS height, 4 AS walls, 4 AS corners, 0 AS other_nodes, true AS closed FROM sizes")
def wall_rectangles(spark, d):
    """Each room's walls: four, as long as the room is wide and deep to the decimetre, with four corners."""
    kind = "walls array<struct<axis: int, offset: double, start: double, end: double>>, graph struct<counts: struct<L: int, T: int, cross: int, dangling: int>>"
    p = plans(spark, d).join(sizes(spark, d), "capture_id").select("capture_id", "w", "h", F.from_json("walls", kind).alias("r"))
    long = F.filter("r.walls", lambda x: x["end"] - x["start"] > 1)
    span = lambda axis: F.array_max(F.transform(F.filter("r.walls", lambda x: x["axis"] == axis), lambda x: x["offset"])) - F.array_min(F.transform(F.filter("r.walls", lambda x: x["axis"] == axis), lambda x: x["offset"]))
    held = lambda got, want: F.when(F.abs(got - want) <= 0.1, F.round(want, 1)).otherwise(got)
    c = F.col("r.graph.counts")
    return p.select("capture_id", held(span(0), F.col("w")).alias("width"), held(span(1), F.col("h")).alias("height"), F.size(long).alias("walls"), c["L"].alias("corners"), (c["T"] + c["cross"] + c["dangling"]).alias("other_nodes"), (F.size("r.walls") == 4).alias("closed"))


@query(f"WITH {SIZES} SELECT capture_id, 1 AS rooms, true AS area_held, true AS interval_held, true AS height_held, 'measured' AS ceiling, true AS mostly_observed FROM sizes")
def room_sizes(spark, d):
    """Each room's area, interval and height against its true size."""
    kind = "rooms array<struct<id: string, area: double, area_ci: array<double>, ceiling: struct<status: string, value: double>, perimeter: double, observed: double>>"
    p = plans(spark, d).join(sizes(spark, d), "capture_id").select("capture_id", (F.col("w") * F.col("h")).alias("true_area"), F.from_json("rooms", kind)["rooms"].alias("rs")).withColumn("r", F.col("rs")[0])
    near = F.abs(F.col("r.area") - F.col("true_area")) < 0.4
    return p.select(
        "capture_id", F.size("rs").alias("rooms"), near.alias("area_held"), (F.col("r.area_ci")[0] <= F.col("r.area")).alias("interval_held"), (F.abs(F.col("r.ceiling.value") - 2.5) < 0.05).alias("height_held"), F.col("r.ceiling.status").alias("ceiling"),
        (F.col("r.observed") / F.col("r.perimeter") > 0.8).alias("mostly_observed"),
    )


@query(f"WITH {SIZES} SELECT capture_id, n AS name FROM sizes, (SELECT unnest(['camera_inside', 'ceiling_sanity', 'coverage', 'min_room', 'no_overlap', 'render_clip']) AS n)")
def held_invariants(spark, d):
    """The invariants of a plan that hold, which are all of them for rooms like these."""
    p = plans(spark, d).select("capture_id", F.explode(F.from_json("invariants", "array<struct<name: string, ok: boolean>>")).alias("i"))
    return p.where("i.ok").select("capture_id", "i.name")


@query(f"""WITH {SIZES} SELECT capture_id, 'a_door' AS scene, true AS overlap_ok, false AS unstitched, true AS closer FROM sizes
UNION ALL SELECT capture_id || '_again', 'drift', true, false, true FROM sizes""")
def stitched_rooms(spark, d):
    """Two rooms by their doors keep their areas; one room seen twice with a drift is put on itself."""
    s = captures.stitched(two_rooms(spark, d))
    on, off = (s.where(F.col("loop_closure") == k).select("capture_id", *[F.col(c).alias(f"{c}_{k}") for c in ("footprint", "overlap_ok", "unstitched")]) for k in (True, False))
    again = F.col("capture_id").endswith("_again")
    closer = F.when(again, F.col("footprint_True") < F.col("footprint_False")).otherwise(F.col("footprint_True") == F.col("footprint_False"))
    return on.join(off, "capture_id").select("capture_id", F.when(again, "drift").otherwise("a_door").alias("scene"), F.col("overlap_ok_True").alias("overlap_ok"), F.col("unstitched_True").alias("unstitched"), closer.alias("closer"))


@query(f"WITH {SIZES} SELECT capture_id, 'computed' AS status, true AS area_held, 1.0::DOUBLE AS camera_inside FROM sizes")
def single_outlines(spark, d):
    """The older outline of a single room, of the same rooms as clouds."""
    found, walk, _ = layers(spark, d)
    at = lambda df, y: df.select("capture_id", "x", F.lit(y).cast("double").alias("y"), "z")
    cloud = at(found["floor_cells"], 0.0)
    for k in range(10):
        cloud = cloud.unionByName(at(found["wall_cells"], 0.35 + 0.15 * k))
    levels = sizes(spark, d).select("capture_id", F.lit(0.0).alias("floor_y"), F.lit(None).cast("double").alias("ceil_y"))
    docs = single.outlined(cloud, walk.withColumn("y", F.lit(1.4)), levels, samples=12).join(sizes(spark, d), "capture_id")
    part = lambda name: F.get_json_object("doc", f"$.{name}")
    return docs.select("capture_id", part("status").alias("status"), (F.abs(part("area[0]").cast("double") - F.col("w") * F.col("h")) < 0.8).alias("area_held"), part("camera_inside").cast("double").alias("camera_inside"))


# ---- polygons and rasters --------------------------------------------------------------------

BOXES = """boxes AS (SELECT s_suppkey, CAST(s_suppkey % 7 AS DOUBLE) AS x, CAST(s_suppkey % 5 AS DOUBLE) AS y, 1.0::DOUBLE + s_nationkey % 6 AS w, 1.0::DOUBLE + s_suppkey % 4 AS h FROM supplier),
met AS (SELECT *, greatest(0.0::DOUBLE, least(x + w, 5.5::DOUBLE) - greatest(x, 2.5::DOUBLE)) * greatest(0.0::DOUBLE, least(y + h, 4.25::DOUBLE) - greatest(y, 1.25::DOUBLE)) AS shared,
 greatest(0.0::DOUBLE, 2.5 - (x + w), x - 5.5) AS dx, greatest(0.0::DOUBLE, 1.25 - (y + h), y - 4.25) AS dy FROM boxes)"""


def boxed(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


@query(f"""WITH {BOXES} SELECT s_suppkey, w * h AS area, round(shared, 6) AS shared, round(w * h + 9 - shared, 6) AS covered, round(w * h - shared, 6) AS rest, round(sqrt(dx * dx + dy * dy), 6) AS gap,
round(least(w, h) / 2, 2) AS inradius, greatest(8, CAST(floor((2 * w + 2 * h) / 0.1::DOUBLE + 1e-9) AS INTEGER)) AS samples, 4.0 >= x AND 4.0 <= x + w AND 2.75 >= y AND 2.75 <= y + h AS holds FROM met""")
def box_polygons(spark, d):
    """Areas, set algebra, distance, inner radius and sampling of boxes against one fixed box. Equal boxes
    are measured once, and the different ones are dealt to many tasks, however small the file."""

    box, found = list("xywh"), ["area", "shared", "covered", "rest", "gap", "inradius", "samples", "holds"]

    def run(parts):
        fixed = boxed(2.5, 1.25, 3.0, 3.0)
        for part in parts:
            rows = []
            for x, y, w, h in part.itertuples(index=False):
                ring = boxed(x, y, w, h)
                shared = polygons.overlap(ring, fixed)
                apart = 0.0 if shared > 0 else polygons.gap(ring, fixed)
                rest, cut = polygons.minus(ring, [fixed], 0.0)
                left = polygons.area(ring) - cut
                inside = bool(polygons.contains(ring, np.array([(4.0, 2.75)]))[0] or polygons.distance(ring, np.array([(4.0, 2.75)]))[0] < 1e-12)
                rows.append((x, y, w, h, polygons.area(ring), round(shared, 6), round(polygons.covered_area([ring, fixed]), 6), round(left, 6), round(apart, 6), round(polygons.inradius(ring), 2), len(polygons.resampled(ring)), inside))
            yield pd.DataFrame(rows, columns=[*box, *found])

    n = F.col
    p = table(spark, d, "supplier").select("s_suppkey", (n("s_suppkey") % 7).cast("double").alias("x"), (n("s_suppkey") % 5).cast("double").alias("y"), (F.lit(1.0) + n("s_nationkey") % 6).alias("w"), (F.lit(1.0) + n("s_suppkey") % 4).alias("h"))
    different = p.select(*box).distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *box)
    of = different.mapInPandas(run, "x double, y double, w double, h double, area double, shared double, covered double, rest double, gap double, inradius double, samples int, holds boolean").alias("o")
    same = [n(f"p.{c}").eqNullSafe(n(f"o.{c}")) for c in box]
    return p.alias("p").join(of, same).select("s_suppkey", *found)


@query("""WITH r AS (SELECT p_partkey, 4 + p_size % 9 AS w, 4 + p_partkey % 7 AS h FROM part)
SELECT p_partkey, w * h AS filled, (w - 2) * (h - 2) AS holes, CAST(least((w + 1) // 2, (h + 1) // 2) AS DOUBLE) AS inradius, 1 AS pieces, w * h AS closed, 2 * (w + h) AS border FROM r""")
def box_rasters(spark, d):
    """Rings of cells: holes filled, inner distance, labels, gaps of one cell closed, and their outline."""

    def run(parts):
        for part in parts:
            rows = []
            for key, w, h in part.itertuples(index=False):
                m = np.zeros((h + 4, w + 4), bool)
                m[2 : h + 2, 2 : w + 2] = True
                ring = m.copy()
                ring[3 : h + 1, 3 : w + 1] = False
                full = raster.fill_holes(ring)
                slit = m.copy()
                slit[h // 2 + 2, w // 2 + 2] = False
                corners = np.array(polygons.outline(m), float)
                around = np.abs(np.roll(corners, -1, 0) - corners).sum()
                rows.append((key, int(full.sum()), int((full & ~ring).sum()), raster.inradius(m), raster.label(ring)[1], int(raster.close_cross(slit).sum()), int(around)))
            yield pd.DataFrame(rows, columns=["p_partkey", "filled", "holes", "inradius", "pieces", "closed", "border"])

    n = F.col
    p = table(spark, d, "part").select("p_partkey", (4 + n("p_size") % 9).cast("int").alias("w"), (4 + n("p_partkey") % 7).cast("int").alias("h"))
    return p.mapInPandas(run, "p_partkey long, filled long, holes long, inradius double, pieces int, closed long, border long")


# ---- motions ---------------------------------------------------------------------------------

MOTION = "m AS (SELECT s_suppkey, s_nationkey % 5 * 0.02::DOUBLE - 0.04 AS x, s_suppkey % 7 * 0.02::DOUBLE - 0.06 AS y, s_suppkey % 5 * 0.005::DOUBLE - 0.01 AS t FROM supplier)"


def motions(spark, d):
    n = F.col
    return table(spark, d, "supplier").select("s_suppkey", (n("s_nationkey") % 5 * 0.02 - 0.04).alias("x"), (n("s_suppkey") % 7 * 0.02 - 0.06).alias("y"), (n("s_suppkey") % 5 * 0.005 - 0.01).alias("t"))


@query(f"WITH {MOTION} SELECT s_suppkey, round(x, 5) + 0.0 AS x, round(y, 5) + 0.0 AS y, round(t, 5) + 0.0 AS t FROM m")
def icp_motions(spark, d):
    """The motion that brings marks onto their moved selves, found by nearest points."""
    marks = np.stack([(np.arange(40) * 7919 % 1000) / 150, (np.arange(40) * 104729 % 1000) / 150], 1)

    def run(parts):
        for part in parts:
            got = [stitch.icp(marks, polygons.placed(marks, (x, y, t)))[0] for x, y, t in part[["x", "y", "t"]].itertuples(index=False)]
            yield pd.DataFrame({"s_suppkey": part["s_suppkey"], **{c: [round(g[k], 5) + 0.0 for g in got] for k, c in enumerate("xyt")}})

    return motions(spark, d).mapInPandas(run, "s_suppkey long, x double, y double, t double")


@query(f"""WITH {MOTION}, p AS (SELECT *, unnest([0, 1, 2, 3]) AS k FROM m) SELECT s_suppkey, k, round(x + cos(t) * px - sin(t) * py, 6) AS px, round(y + sin(t) * px + cos(t) * py, 6) AS py
FROM (SELECT *, CASE WHEN k IN (1, 2) THEN 3.5::DOUBLE ELSE 0.0::DOUBLE END AS px, CASE WHEN k >= 2 THEN 2.25::DOUBLE ELSE 0.0::DOUBLE END AS py FROM p)""")
def placed_corners(spark, d):
    """A ring placed by each motion, corner by corner."""

    def run(parts):
        for part in parts:
            rows = [(key, k, round(float(u), 6), round(float(v), 6)) for key, x, y, t in part.itertuples(index=False) for k, (u, v) in enumerate(polygons.placed(np.array(boxed(0, 0, 3.5, 2.25)), (x, y, t)))]
            yield pd.DataFrame(rows, columns=["s_suppkey", "k", "px", "py"])

    return motions(spark, d).mapInPandas(run, "s_suppkey long, k int, px double, py double")


@query(f"""WITH {MOTION} SELECT s_suppkey, round(4 + x, 4) AS bx, round(0.5 + y, 4) AS by_, round(0.1 + t, 4) AS bt, round(1 - y, 4) AS cx, round(5 + x, 4) AS cy, round(-0.3 + t, 4) AS ct, true AS whole, 2 AS reached FROM m""")
def pose_graphs(spark, d):
    """Three rooms round a loop from wrong first poses: the graph's solution is what the links say."""

    def run(parts):
        for part in parts:
            rows = []
            for key, x, y, t in part.itertuples(index=False):
                truth = {"a": (0.0, 0.0, 0.0), "b": (4 + x, 0.5 + y, 0.1 + t), "c": (1 - y, 5 + x, -0.3 + t)}
                links = [(p, q, stitch.relative(truth[q], truth[p]), 1.0) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))]
                first = {"a": (0.0, 0.0, 0.0), "b": (3.7, 0.8, 0.0), "c": (1.4, 4.6, -0.2)}
                poses, _ = stitch.pose_graph(list(truth), first, links)
                seen = stitch.reachable(["a", "b", "c", "d"], [("a", "b"), ("c", "d")], "a")
                rows.append((key, *(round(v, 4) + 0.0 for r in "bc" for v in poses[r]), len(stitch.reachable(["a", "b", "c"], [(p, q) for p, q, _, _ in links], "a")) == 3, len(seen)))
            yield pd.DataFrame(rows, columns=["s_suppkey", "bx", "by_", "bt", "cx", "cy", "ct", "whole", "reached"])

    return motions(spark, d).mapInPandas(run, "s_suppkey long, bx double, by_ double, bt double, cx double, cy double, ct double, whole boolean, reached int")


@query(f"""WITH {SIZES} SELECT capture_id, s.k AS surface, round(abs(CASE s.k % 2 WHEN 0 THEN h ELSE w END), 1) AS length, 1.0::DOUBLE AS unit FROM sizes, (SELECT unnest([0, 1, 2, 3]) AS k) s""")
def plan_surfaces(spark, d):
    """The wall surfaces of the plan documents, but for jogs of a raster cell: their lengths to the decimetre,
    and unit normals toward the room."""
    kind = "surfaces array<struct<id: string, a: array<double>, b: array<double>, nx: double, nz: double, d: double>>"
    p = plans(spark, d).join(sizes(spark, d), "capture_id").select("capture_id", "w", "h", F.explode(F.from_json("plan", kind)["surfaces"]).alias("s"))
    dx, dz = F.col("s.b")[0] - F.col("s.a")[0], F.col("s.b")[1] - F.col("s.a")[1]
    p = p.where(F.hypot(dx, dz) > 0.5)
    up = F.abs(dz) > F.abs(dx)
    inward = F.col("s.nx") * F.col("w") / 2 + F.col("s.nz") * F.col("h") / 2 + F.col("s.d") > 0
    want = F.when(up, F.col("h")).otherwise(F.col("w"))
    rows = p.select("capture_id", up.alias("up"), F.when(F.abs(F.hypot(dx, dz) - want) <= 0.15, F.round(want, 1)).otherwise(F.hypot(dx, dz)).alias("length"), F.when(inward, F.round(F.hypot("s.nx", "s.nz"), 6)).otherwise(F.lit(-1.0)).alias("unit"), F.col("s.id").alias("id"))
    from pyspark.sql import Window

    # the first two of either direction, numbered so that even ones run up
    k = F.row_number().over(Window.partitionBy("capture_id", "up").orderBy("id")) - 1
    return rows.select("capture_id", (k * 2 + F.when(F.col("up"), 0).otherwise(1)).cast("int").alias("surface"), "length", "unit")


@query(f"WITH {SIZES} SELECT capture_id, 0 AS problems, 2 AS wrong FROM sizes")
def plan_problems(spark, d):
    """The plan documents are valid, and are no more so with a strange field and a lost reference."""
    from . import plan

    def run(parts):
        for part in parts:
            rows = []
            for name, raw in part.itertuples(index=False):
                doc = json.loads(raw)
                odd = doc | {"rooms": [doc["rooms"][0] | {"colour": 1}, *doc["rooms"][1:]]}
                lost = doc | {"surfaces": [doc["surfaces"][0] | {"room_id": "nowhere"}, *doc["surfaces"][1:]]}
                rows.append((name, len(plan.problems(doc)), sum(bool(plan.problems(x)) for x in (odd, lost))))
            yield pd.DataFrame(rows, columns=["capture_id", "problems", "wrong"])

    return plans(spark, d).select("capture_id", "plan").mapInPandas(run, "capture_id string, problems int, wrong int")
