"""Queries that run the steps of a capture (reconstruction, evidence, surfaces, checks) over the driver's
tables, with the SQL that says the same.

Adapters: suppliers are posed frames and walls, lineitem rows are their depth pixels or cloud points,
events are camera paths, nations are rooms, regions captures.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .. import schemas
from ..functions import measures, spatial
from ..operators import grid, joins, path, poly, rules
from ..sources import bundle
from . import damage, evidence, recon
from .catalogue import CAMERA, CORNERS, ORDER, RING, SPANS, camera, corners, query, spans, table, wall_lines

WALLS = "walls AS (SELECT s_suppkey, 900 + s_suppkey % 100 + 0.37::DOUBLE AS off, CAST(s_nationkey * 2 AS DOUBLE) AS a, CAST(s_nationkey * 2 + 10 AS DOUBLE) AS b FROM supplier)"

# ---- poses and clouds ------------------------------------------------------------------------

FRAMES = """frames AS (SELECT CAST(s_nationkey AS VARCHAR) AS capture_id, CAST(s_suppkey AS VARCHAR) AS frame, CAST(s_suppkey AS INTEGER) AS idx, s_acctbal / 1000 AS x, s_suppkey * 0.25::DOUBLE AS y, s_nationkey * 1.5::DOUBLE AS z,
 s_nationkey - 12.0::DOUBLE AS qx, 3.0::DOUBLE AS qy, CAST(s_suppkey % 7 AS DOUBLE) AS qz, 5.0::DOUBLE AS qw FROM supplier)"""
ROTATED = FRAMES + """, turned AS (SELECT *, 2 / (qx * qx + qy * qy + qz * qz + qw * qw) AS k FROM frames),
poses AS (SELECT *, 1 - k * (qy * qy + qz * qz) AS m0, k * (qx * qy - qz * qw) AS m1, k * (qx * qz + qy * qw) AS m2, x AS m3, k * (qx * qy + qz * qw) AS m4, 1 - k * (qx * qx + qz * qz) AS m5, k * (qy * qz - qx * qw) AS m6, y AS m7,
 k * (qx * qz - qy * qw) AS m8, k * (qy * qz + qx * qw) AS m9, 1 - k * (qx * qx + qy * qy) AS m10, z AS m11 FROM turned)"""
DEPTH = """depth AS (SELECT CAST(s_nationkey AS VARCHAR) AS capture_id, CAST(l_suppkey AS VARCHAR) AS name, CAST(l_partkey % 256 AS INTEGER) AS u, CAST(l_orderkey % 192 AS INTEGER) AS v,
 CASE WHEN l_linenumber = 7 THEN 0 ELSE CAST(floor(l_extendedprice / 10) AS INTEGER) END AS depth, CAST(l_linenumber % 3 AS INTEGER) AS confidence FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)"""


def world(gates: str) -> str:
    return f"""{ROTATED}, {DEPTH}, cam AS (SELECT p.*, d.u, d.v, d.depth * 0.001::DOUBLE AS zc, (d.u - 64.0) * (d.depth * 0.001::DOUBLE) / (100.0::DOUBLE * 0.5) AS xc, (d.v - 48.0) * (d.depth * 0.001::DOUBLE) / (120.0::DOUBLE * 0.5) AS yc
 FROM depth d JOIN poses p ON p.capture_id = d.capture_id AND p.frame = d.name WHERE d.depth > 0{gates}),
points AS (SELECT capture_id, idx, CAST(idx AS BIGINT) * 4294967296 + v * 65536 + u AS pid, m0 * xc + m1 * yc + m2 * zc + m3 AS x, m4 * xc + m5 * yc + m6 * zc + m7 AS y, m8 * xc + m9 * yc + m10 * zc + m11 AS z FROM cam)"""


GATED = world(" AND d.depth * 0.001::DOUBLE <= 8.0 AND d.confidence >= 1")


def frames(spark, d):
    s, n = table(spark, d, "supplier"), F.col
    number = lambda c: c.cast("double")
    return s.select(
        n("s_nationkey").cast("string").alias("capture_id"), n("s_suppkey").cast("string").alias("frame"), n("s_suppkey").cast("int").alias("idx"), (n("s_acctbal") / 1000).alias("x"), (n("s_suppkey") * 0.25).alias("y"), (n("s_nationkey") * 1.5).alias("z"),
        number(n("s_nationkey") - 12).alias("qx"), F.lit(3.0).alias("qy"), number(n("s_suppkey") % 7).alias("qz"), F.lit(5.0).alias("qw"), F.lit(100.0).alias("fx"), F.lit(120.0).alias("fy"), F.lit(128.0).alias("cx"), F.lit(96.0).alias("cy"),
    )


def depth(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("capture_id"))
    mm = F.when(F.col("l_linenumber") == 7, 0).otherwise(F.floor(F.col("l_extendedprice") / 10)).cast("int")
    return table(spark, d, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("capture_id", F.col("l_suppkey").cast("string").alias("name"), (F.col("l_partkey") % 256).cast("int").alias("u"), (F.col("l_orderkey") % 192).cast("int").alias("v"), mm.alias("depth"), (F.col("l_linenumber") % 3).cast("int").alias("confidence"))


def points(spark, d, gates=True):
    return recon.world_points(depth(spark, d), frames(spark, d), gates=gates, sx=0.5, sy=0.5)


@query(f"WITH {ROTATED} SELECT capture_id, idx, " + ", ".join(f"round(m{k}, 9) AS m{k}" for k in range(12)) + " FROM poses")
def quaternion_poses(spark, d):
    return recon.poses(frames(spark, d)).select("capture_id", "idx", *[F.round(F.col("m")[k], 9).alias(f"m{k}") for k in range(12)])


@query(f"WITH {GATED} SELECT capture_id, idx, pid, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM points")
def world_points(spark, d):
    return points(spark, d).select("capture_id", "idx", "pid", *[F.round(c, 6).alias(c) for c in "xyz"])


@query(f"WITH {world('')} SELECT capture_id, count(*) AS n, count(DISTINCT pid) AS pixels, round(max(abs(x)), 6) AS far FROM points GROUP BY capture_id")
def unfiltered_points(spark, d):
    return points(spark, d, False).groupBy("capture_id").agg(F.count("*").alias("n"), F.countDistinct("pid").alias("pixels"), F.round(F.max(F.abs("x")), 6).alias("far"))


@query(f"""WITH {GATED} SELECT capture_id, count(*) AS voxels, CAST(sum(pid % 1000003) AS BIGINT) AS first_pids FROM (SELECT capture_id, min(pid) AS pid FROM points
GROUP BY capture_id, floor(x / 0.5::DOUBLE), floor(y / 0.5::DOUBLE), floor(z / 0.5::DOUBLE)) GROUP BY capture_id""")
def cloud_voxels(spark, d):
    return recon.voxelised(points(spark, d), 0.5).groupBy("capture_id").agg(F.count("*").alias("voxels"), F.sum(F.col("pid") % 1000003).alias("first_pids"))


@query(f"""WITH {GATED}, low AS (SELECT capture_id, quantile_cont(y, 0.02) AS q FROM points GROUP BY 1), rms AS (SELECT capture_id, stddev_pop(y) AS plane_rms FROM points JOIN low USING (capture_id) WHERE abs(y - q) <= 0.05 GROUP BY 1)
SELECT capture_id, avg(CASE WHEN depth > 0 THEN 1.0 ELSE 0.0 END) AS coverage, count(DISTINCT name) AS track_len, round(any_value(plane_rms), 7) AS plane_rms FROM depth LEFT JOIN rms USING (capture_id) GROUP BY capture_id""")
def recon_quality(spark, d):
    return recon.quality(depth(spark, d), points(spark, d)).withColumn("plane_rms", F.round("plane_rms", 7))


# ---- planes and evidence ---------------------------------------------------------------------

ROOM_CLOUD = """cloud AS (SELECT CAST(l_suppkey % 5 AS VARCHAR) AS capture_id, l_extendedprice / 10000 AS x, l_quantity / 10 AS z,
 CASE WHEN l_linenumber % 3 = 0 THEN l_tax * 0.2::DOUBLE WHEN l_linenumber % 3 = 1 THEN 2.4::DOUBLE + l_discount * 0.1::DOUBLE ELSE (l_orderkey % 240) * 0.01::DOUBLE + 0.003::DOUBLE END AS y FROM lineitem)"""
LEVELS = ROOM_CLOUD + """, bins AS (SELECT capture_id, CAST(floor(y / 0.01::DOUBLE) AS BIGINT) AS bin, count(*) AS n FROM cloud GROUP BY 1, 2),
dense AS (SELECT s.capture_id, s.bin, coalesce(n, 0) AS n FROM (SELECT capture_id, unnest(generate_series(min(bin), max(bin))) AS bin FROM bins GROUP BY 1) s LEFT JOIN bins USING (capture_id, bin)),
smooth AS (SELECT *, CAST(sum(n) OVER (PARTITION BY capture_id ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS BIGINT) / 5.0::DOUBLE AS s FROM dense),
typical AS (SELECT capture_id, median(s) AS t FROM smooth WHERE n > 0 GROUP BY 1),
sided AS (SELECT *, coalesce(lag(s) OVER w, 0) AS l, coalesce(lead(s) OVER w, 0) AS r FROM smooth JOIN typical USING (capture_id) WINDOW w AS (PARTITION BY capture_id ORDER BY bin)),
peaks AS (SELECT capture_id, bin, s FROM sided WHERE s >= l AND s >= r AND s > 0 AND s >= 2.5 * t),
one AS (SELECT capture_id, bin FROM peaks QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY s DESC, bin) = 1),
two AS (SELECT p.capture_id, p.bin FROM peaks p JOIN one ON one.capture_id = p.capture_id AND abs(p.bin - one.bin) >= 180 QUALIFY row_number() OVER (PARTITION BY p.capture_id ORDER BY s DESC, p.bin) = 1),
near AS (SELECT c.capture_id, o.k, avg(y) AS mean FROM cloud c JOIN (SELECT *, 1 AS k FROM one UNION ALL SELECT *, 2 FROM two) o ON o.capture_id = c.capture_id AND abs(y - (o.bin + 0.5) * 0.01::DOUBLE) <= 0.03 GROUP BY 1, 2),
again AS (SELECT c.capture_id, k, any_value(mean) AS y, count(*) AS support FROM cloud c JOIN near USING (capture_id) WHERE abs(y - mean) <= 0.03 GROUP BY 1, 2),
held AS (SELECT a.capture_id, a.y FROM again a JOIN (SELECT capture_id, count(*) AS total FROM cloud GROUP BY 1) USING (capture_id) WHERE support >= 0.02 * total),
levels AS (SELECT capture_id, min(y) AS floor_y, CASE WHEN max(y) - min(y) >= 0.9 THEN max(y) END AS ceil_y FROM held GROUP BY 1)"""
FIXED = ROOM_CLOUD + """, band AS (SELECT capture_id, CAST(floor(x / 0.02::DOUBLE) AS BIGINT) AS i, CAST(floor(z / 0.02::DOUBLE) AS BIGINT) AS j, greatest(0, least(9, CAST(trunc((y - 0.25::DOUBLE) / (2.15::DOUBLE - 0.25::DOUBLE) * 10) AS BIGINT))) AS hb
 FROM cloud WHERE y > 0.25::DOUBLE AND y < 2.15::DOUBLE),
wall_cells AS (SELECT capture_id, (i + 0.5) * 0.02::DOUBLE AS x, (j + 0.5) * 0.02::DOUBLE AS z, count(DISTINCT hb) AS support FROM band GROUP BY capture_id, i, j),
floor_cells AS (SELECT DISTINCT capture_id, (floor(x / 0.1::DOUBLE) + 0.5) * 0.1::DOUBLE AS x, (floor(z / 0.1::DOUBLE) + 0.5) * 0.1::DOUBLE AS z FROM cloud WHERE abs(y) <= 0.08),
walk AS (SELECT CAST(user_id % 5 AS VARCHAR) AS capture_id, x / 10 AS x, z / 20 AS z FROM camera), free_cells AS (SELECT DISTINCT capture_id, (floor(x / 0.1::DOUBLE) + 0.5) * 0.1::DOUBLE AS x, (floor(z / 0.1::DOUBLE) + 0.5) * 0.1::DOUBLE AS z FROM walk)"""


def room_cloud(spark, d):
    t, n = table(spark, d, "lineitem"), F.col
    y = F.when(n("l_linenumber") % 3 == 0, n("l_tax") * 0.2).when(n("l_linenumber") % 3 == 1, F.lit(2.4) + n("l_discount") * 0.1).otherwise((n("l_orderkey") % 240) * 0.01 + 0.003)
    return t.select((n("l_suppkey") % 5).cast("string").alias("capture_id"), (n("l_extendedprice") / 10000).alias("x"), y.alias("y"), (n("l_quantity") / 10).alias("z"))


def found_layers(spark, d):
    cloud = room_cloud(spark, d)
    walk = camera(spark, d).select((F.col("user_id") % 5).cast("string").alias("capture_id"), (F.col("x") / 10).alias("x"), (F.col("z") / 20).alias("z"))
    levels = spark.createDataFrame([(str(k), 0.0, 2.4) for k in range(5)], "capture_id string, floor_y double, ceil_y double")
    return evidence.layers(cloud, walk, levels), walk


@query(f"WITH {LEVELS} SELECT capture_id, round(floor_y, 6) AS floor_y, round(ceil_y, 6) AS ceil_y FROM levels")
def capture_planes(spark, d):
    return evidence.planes(room_cloud(spark, d)).select("capture_id", F.round("floor_y", 6).alias("floor_y"), F.round("ceil_y", 6).alias("ceil_y"))


@query(f"WITH {CAMERA}, {FIXED} SELECT capture_id, round(x, 6) AS x, round(z, 6) AS z, support FROM wall_cells")
def evidence_wall_cells(spark, d):
    return found_layers(spark, d)[0]["wall_cells"].select("capture_id", F.round("x", 6).alias("x"), F.round("z", 6).alias("z"), "support")


@query(f"WITH {CAMERA}, {FIXED} SELECT 'floor' AS layer, capture_id, round(x, 6) AS x, round(z, 6) AS z FROM floor_cells UNION ALL SELECT 'free', capture_id, round(x, 6), round(z, 6) FROM free_cells")
def evidence_flat_cells(spark, d):
    found, _ = found_layers(spark, d)
    pick = lambda name: found[f"{name}_cells"].select(F.lit(name).alias("layer"), "capture_id", F.round("x", 6).alias("x"), F.round("z", 6).alias("z"))
    return pick("floor").unionByName(pick("free"))


@query(f"""WITH {CAMERA}, {FIXED}, marks AS (SELECT DISTINCT capture_id, floor(x / 0.1::DOUBLE) AS i, floor(z / 0.1::DOUBLE) AS j FROM (SELECT capture_id, x, z FROM wall_cells UNION ALL SELECT * FROM floor_cells)),
hit AS (SELECT w.capture_id, EXISTS (SELECT 1 FROM marks m WHERE m.capture_id = w.capture_id AND abs(m.i - floor(w.x / 0.1::DOUBLE)) <= 1 AND abs(m.j - floor(w.z / 0.1::DOUBLE)) <= 1) AS h FROM walk w)
SELECT capture_id, count(*) FILTER (WHERE h) / count(*) AS camera_inside, (SELECT count(*) FROM wall_cells c WHERE c.capture_id = hit.capture_id) AS wall_cells, (SELECT count(*) FROM floor_cells c WHERE c.capture_id = hit.capture_id) AS floor_cells,
(SELECT count(*) FROM free_cells c WHERE c.capture_id = hit.capture_id) AS free_cells FROM hit GROUP BY capture_id""")
def evidence_statistics(spark, d):
    found, walk = found_layers(spark, d)
    return evidence.statistics(found, walk)


# ---- coloured surfaces -----------------------------------------------------------------------

PAINTED = """walls AS (SELECT CAST(n_regionkey AS VARCHAR) AS capture_id, 'w' || n_nationkey AS surface_id, n_nationkey * 0.4::DOUBLE AS off, 0.5 + n_nationkey % 2 AS far FROM nation),
painted AS (SELECT CAST(l_suppkey % 5 AS VARCHAR) AS capture_id, l_orderkey * 8 + l_linenumber AS pid, l_extendedprice / 10000 AS x, l_linenumber * 0.3::DOUBLE AS y, l_quantity / 25 AS z, CAST(l_partkey % 256 AS INTEGER) AS r, CAST(l_orderkey % 256 AS INTEGER) AS g, CAST(l_suppkey % 200 AS INTEGER) AS b2 FROM lineitem),
assigned AS (SELECT * FROM (SELECT p.*, w.surface_id, abs(x - off) AS dist, z AS along FROM painted p JOIN walls w USING (capture_id) WHERE y >= 0.2 AND y <= 2.2 AND abs(x - off) < 0.08 AND z >= 0 AND z < far)
 QUALIFY row_number() OVER (PARTITION BY capture_id, pid ORDER BY dist, surface_id, along, y, r, g, b2) = 1)"""


def painted(spark, d):
    n = F.col
    t = table(spark, d, "lineitem").select(
        (n("l_suppkey") % 5).cast("string").alias("capture_id"), (n("l_orderkey") * 8 + n("l_linenumber")).alias("pid"), (n("l_extendedprice") / 10000).alias("x"), (n("l_linenumber") * 0.3).alias("y"), (n("l_quantity") / 25).alias("z"),
        (n("l_partkey") % 256).cast("int").alias("r"), (n("l_orderkey") % 256).cast("int").alias("g"), (n("l_suppkey") % 200).cast("int").alias("b2"),
    )
    off, far = n("n_nationkey") * 0.4, F.lit(0.5) + n("n_nationkey") % 2
    walls = table(spark, d, "nation").select(
        n("n_regionkey").cast("string").alias("capture_id"), F.concat(F.lit("w"), n("n_nationkey").cast("string")).alias("id"), F.lit("wall").alias("type"), F.array(off, F.lit(0.0)).alias("a"), F.array(off, far.cast("double")).alias("b"), F.lit(1.0).alias("nx"), F.lit(0.0).alias("nz"), (-off).alias("d"),
    )
    return damage.assigned(t, walls.unionByName(walls.withColumn("type", F.lit("floor")).withColumn("id", F.lit("a floor"))))


@query(f"WITH {PAINTED} SELECT capture_id, pid, surface_id, round(along, 9) AS along, r, g, b2 AS b FROM assigned")
def surface_assignment(spark, d):
    return painted(spark, d).select("capture_id", "pid", "surface_id", F.round("along", 9).alias("along"), "r", "g", "b")


@query(f"""WITH {PAINTED}, s AS (SELECT capture_id, surface_id, CAST(floor((y - 0.0 - 0.2::DOUBLE) / 0.05::DOUBLE) AS BIGINT) AS i, CAST(floor(along / 0.05::DOUBLE) AS BIGINT) AS j, CAST(sum(r) AS BIGINT) AS sr, CAST(sum(g) AS BIGINT) AS sg, CAST(sum(b2) AS BIGINT) AS sb, count(*) AS n FROM assigned GROUP BY 1, 2, 3, 4)
SELECT capture_id, surface_id, i, j, n, CASE WHEN n >= 3 THEN sr / n END AS r, CASE WHEN n >= 3 THEN sg / n END AS g, CASE WHEN n >= 3 THEN sb / n END AS b FROM s""")
def surface_evidence(spark, d):
    return damage.surface_grid(painted(spark, d)).select("capture_id", "surface_id", "i", "j", "n", "r", "g", "b")


@query("""WITH f AS (SELECT l_suppkey AS surface, min(l_linenumber) AS i0, max(l_linenumber) AS i1, min(CAST(l_quantity AS BIGINT)) AS j0, max(CAST(l_quantity AS BIGINT)) AS j1 FROM lineitem GROUP BY 1),
s AS (SELECT s_suppkey AS surface, s_acctbal / 100 AS ax, CAST(s_nationkey AS DOUBLE) AS az, s_acctbal / 100 + 3 + s_nationkey % 3 AS bx, s_nationkey + 4.0::DOUBLE AS bz FROM supplier),
t AS (SELECT *, sqrt((bx - ax) * (bx - ax) + (bz - az) * (bz - az)) AS n FROM f JOIN s USING (surface))
SELECT surface AS id, round(ax + (bx - ax) / n * j0 * 0.05::DOUBLE, 6) AS x0, round(az + (bz - az) / n * j0 * 0.05::DOUBLE, 6) AS z0, round(ax + (bx - ax) / n * (j1 + 1) * 0.05::DOUBLE, 6) AS x1, round(az + (bz - az) / n * (j1 + 1) * 0.05::DOUBLE, 6) AS z1,
round(i0 * 0.05::DOUBLE + 0.2, 6) AS low, round((i1 + 1) * 0.05::DOUBLE + 0.2, 6) AS high FROM t""")
def damage_rectangles(spark, d):
    f = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("surface_id")).agg(F.min("l_linenumber").alias("i0"), F.max("l_linenumber").alias("i1"), F.min(F.col("l_quantity").cast("long")).alias("j0"), F.max(F.col("l_quantity").cast("long")).alias("j1"))
    f = f.withColumn("capture_id", F.lit("c")).withColumn("id", F.col("surface_id")).withColumn("kind", F.lit("crack"))
    n, x = F.col("s_nationkey"), F.col("s_acctbal") / 100
    s = table(spark, d, "supplier").select(F.lit("c").alias("capture_id"), F.col("s_suppkey").alias("id"), F.array(x, n.cast("double")).alias("a"), F.array(x + 3 + n % 3, n + 4.0).alias("b"))
    return damage.rectangles(f, s).select("id", *[F.round(c, 6).alias(c) for c in ("x0", "z0", "x1", "z1", "low", "high")])


# ---- rigid motions and distances -------------------------------------------------------------


@query("""SELECT s_suppkey, round(u, 6) AS u, round(v, 6) AS v, round(u * cos(t) - v * sin(t), 6) AS x, round(u * sin(t) + v * cos(t), 6) AS z
FROM (SELECT *, x * cos(t) + z * sin(t) AS u, z * cos(t) - x * sin(t) AS v FROM (SELECT s_suppkey, s_acctbal / 100 AS x, CAST(s_suppkey AS DOUBLE) AS z, s_nationkey * 0.3::DOUBLE AS t FROM supplier))""")
def rotated_points(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 100).alias("x"), F.col("s_suppkey").cast("double").alias("z"), (F.col("s_nationkey") * 0.3).alias("t"))
    u, v = spatial.rotate_uv(F.col("x"), F.col("z"), F.col("t"))
    s = s.select("s_suppkey", "t", u.alias("u"), v.alias("v"))
    x, z = spatial.unrotate_uv(F.col("u"), F.col("v"), F.col("t"))
    return s.select("s_suppkey", F.round("u", 6).alias("u"), F.round("v", 6).alias("v"), F.round(x, 6).alias("x"), F.round(z, 6).alias("z"))


@query(f"""WITH t AS (SELECT s_suppkey, s_acctbal / 1000 AS ax, s_suppkey / 10.0::DOUBLE AS ay, s_nationkey * 0.7::DOUBLE AS ath, 1.5::DOUBLE AS bx, -0.5::DOUBLE AS by_, s_suppkey * 0.1::DOUBLE AS bt FROM supplier)
SELECT s_suppkey, round(cos(ath) * (bx - ax) + sin(ath) * (by_ - ay), 6) AS x, round(cos(ath) * (by_ - ay) - sin(ath) * (bx - ax), 6) AS y,
round((bt - ath + {math.pi}::DOUBLE) - floor((bt - ath + {math.pi}::DOUBLE) / {2 * math.pi}::DOUBLE) * {2 * math.pi}::DOUBLE - {math.pi}::DOUBLE, 5) AS theta, round(ax + cos(ath) * 2 - sin(ath) * 3, 6) AS px, round(ay + sin(ath) * 2 + cos(ath) * 3, 6) AS py FROM t""")
def se2_relative(spark, d):
    s = table(spark, d, "supplier")
    a = spatial.se2(F.col("s_acctbal") / 1000, F.col("s_suppkey") / 10.0, F.col("s_nationkey") * 0.7)
    b = spatial.se2(F.lit(1.5), F.lit(-0.5), F.col("s_suppkey") * 0.1)
    t = s.select("s_suppkey", a.alias("a"), b.alias("b")).select("s_suppkey", "a", spatial.relative(F.col("a"), F.col("b")).alias("r"))
    px, py = spatial.apply_se2(F.col("a"), F.lit(2.0), F.lit(3.0))
    return t.select("s_suppkey", F.round("r.x", 6).alias("x"), F.round("r.y", 6).alias("y"), F.round("r.theta", 5).alias("theta"), F.round(px, 6).alias("px"), F.round(py, 6).alias("py"))


SEGMENTS = """segments AS (SELECT s_suppkey, s_nationkey AS room, s_acctbal / 100 AS ax, CAST(s_suppkey % 60 AS DOUBLE) AS ay, s_acctbal / 100 + s_suppkey % 4 AS bx, CAST(s_suppkey % 60 + s_nationkey % 5 AS DOUBLE) AS by_ FROM supplier),
doors AS (SELECT c_custkey, c_nationkey AS room, c_acctbal / 100 AS px, CAST(c_custkey % 80 AS DOUBLE) AS py FROM customer),
met AS (SELECT *, CASE WHEN n2 > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / n2)) ELSE 0.0::DOUBLE END AS t FROM (SELECT *, (bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) AS n2 FROM doors JOIN segments USING (room))),
far AS (SELECT *, sqrt((px - (ax + t * (bx - ax))) * (px - (ax + t * (bx - ax))) + (py - (ay + t * (by_ - ay))) * (py - (ay + t * (by_ - ay)))) AS dist FROM met)"""


def doors_and_segments(spark, d):
    n = F.col
    s = table(spark, d, "supplier").select("s_suppkey", n("s_nationkey").alias("room"), (n("s_acctbal") / 100).alias("ax"), (n("s_suppkey") % 60).cast("double").alias("ay"), (n("s_acctbal") / 100 + n("s_suppkey") % 4).alias("bx"), (n("s_suppkey") % 60 + n("s_nationkey") % 5).cast("double").alias("by"))
    c = table(spark, d, "customer").select("c_custkey", n("c_nationkey").alias("room"), (n("c_acctbal") / 100).alias("px"), (n("c_custkey") % 80).cast("double").alias("py"))
    return c, s, spatial.point_segment_distance(*(n(k) for k in ("px", "py", "ax", "ay", "bx", "by")))


@query(f"WITH {SEGMENTS} SELECT room, c_custkey, s_suppkey, round(dist, 6) AS dist FROM far")
def point_segment_distances(spark, d):
    """All pairs of a room. Its points are dealt to many tasks, each with all of the room's segments: the
    pairs are far more than the rows that adaptive execution goes by."""
    c, s, dist = doors_and_segments(spark, d)
    n, deal = int(spark.conf.get("spark.sql.shuffle.partitions")), 32
    c = c.withColumn("_s", F.pmod(F.hash("c_custkey"), F.lit(deal))).repartition(n, "room", "_s")
    s = s.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(deal - 1)))).repartition(n, "room", "_s")
    return c.join(s, ["room", "_s"]).select("room", "c_custkey", "s_suppkey", measures.rounded(dist, 6).alias("dist"))


@query(f"WITH {SEGMENTS} SELECT room, c_custkey, s_suppkey, round(dist, 6) AS dist FROM far QUALIFY row_number() OVER (PARTITION BY c_custkey, room ORDER BY dist, s_suppkey) = 1")
def opening_host_walls(spark, d):
    c, s, dist = doors_and_segments(spark, d)
    return joins.nearest_segment(c, s, ["room"], ["c_custkey"], "s_suppkey", dist).withColumn("dist", F.round("dist", 6))


@query("""WITH t AS (SELECT s_suppkey, s_acctbal / 100 AS ax, CAST(s_nationkey AS DOUBLE) AS ay, s_acctbal / 100 + 3 AS bx, s_nationkey + s_suppkey % 5 - 2.0::DOUBLE AS by_, 20.0::DOUBLE AS cx, 10.0::DOUBLE AS cy FROM supplier),
u AS (SELECT *, -(by_ - ay) / sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) AS nx, (bx - ax) / sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) AS ny FROM t),
v AS (SELECT *, CASE WHEN nx * (cx - ax) + ny * (cy - ay) < 0 THEN -1.0 ELSE 1.0 END AS s FROM u) SELECT s_suppkey, round(nx * s + 0.0, 6) AS nx, round(ny * s, 6) AS ny, round(-(nx * s * ax + ny * s * ay), 5) AS d FROM v""")
def inward_planes(spark, d):
    n = F.col
    nx, ny, off = spatial.inward_plane(n("s_acctbal") / 100, n("s_nationkey").cast("double"), n("s_acctbal") / 100 + 3, n("s_nationkey") + n("s_suppkey") % 5 - 2.0, F.lit(20.0), F.lit(10.0))
    return table(spark, d, "supplier").select("s_suppkey", F.round(nx + 0.0, 6).alias("nx"), F.round(ny, 6).alias("ny"), F.round(off, 5).alias("d"))


@query(f"""WITH t AS (SELECT s_suppkey, s_acctbal / 100 AS ax, CAST(s_nationkey AS DOUBLE) AS ay, cos(s_suppkey * 0.3::DOUBLE) AS anx, sin(s_suppkey * 0.3::DOUBLE) AS any_, s_suppkey / 7.0::DOUBLE AS bx, 2.0::DOUBLE AS by_, cos(s_nationkey * 0.9::DOUBLE) AS bnx, sin(s_nationkey * 0.9::DOUBLE) AS bny FROM supplier),
u AS (SELECT *, atan2(-any_, -anx) - atan2(bny, bnx) AS raw FROM t), v AS (SELECT *, (raw + {math.pi}::DOUBLE) - floor((raw + {math.pi}::DOUBLE) / {2 * math.pi}::DOUBLE) * {2 * math.pi}::DOUBLE - {math.pi}::DOUBLE AS th FROM u)
SELECT s_suppkey, round(ax - (cos(th) * bx - sin(th) * by_), 5) AS x, round(ay - (sin(th) * bx + cos(th) * by_), 5) AS y, round(th, 5) AS theta FROM v""")
def connector_transforms(spark, d):
    n = F.col
    a, b = n("s_suppkey") * 0.3, n("s_nationkey") * 0.9
    c = spatial.connector(n("s_acctbal") / 100, n("s_nationkey").cast("double"), F.cos(a), F.sin(a), n("s_suppkey") / 7.0, F.lit(2.0), F.cos(b), F.sin(b))
    return table(spark, d, "supplier").select("s_suppkey", c.alias("c")).select("s_suppkey", *[F.round(f"c.{k}", 5).alias(k) for k in ("x", "y", "theta")])


# ---- walls and rooms -------------------------------------------------------------------------


@query(f"""WITH {SPANS}, e AS (SELECT o_custkey, o_orderkey, "start" AS a0, "end" AS a1 FROM spans), p AS (SELECT o_custkey, o_orderkey % 17 AS ci, "start" + 5 AS b0, "end" + 3 AS b1 FROM spans)
SELECT o_custkey, o_orderkey, max(ci) AS ci, count(*) AS pieces, CAST(sum(least(a1, b1) - greatest(a0, b0)) AS BIGINT) AS shared FROM e JOIN p USING (o_custkey) WHERE a0 < b1 AND b0 < a1 GROUP BY 1, 2""")
def edge_intervals(spark, d):
    """Each edge with the largest interval of the pieces that it overlaps on its line."""
    e = spans(spark, d).select("o_custkey", "o_orderkey", F.col("start").alias("a0"), F.col("end").alias("a1"))
    p = spans(spark, d).select("o_custkey", (F.col("o_orderkey") % 17).alias("ci"), (F.col("start") + 5).alias("b0"), (F.col("end") + 3).alias("b1"))
    met = joins.overlapping(e, p, ["o_custkey"], ("a0", "a1"), ("b0", "b1"), 50)
    return met.groupBy("o_custkey", "o_orderkey").agg(F.max("ci").alias("ci"), F.count("*").alias("pieces"), F.sum(F.least("a1", "b1") - F.greatest("a0", "b0")).alias("shared"))


@query(f"""WITH {WALLS} SELECT p_partkey, s_suppkey, abs(p_retailprice - off) AS dist FROM part JOIN walls ON abs(p_retailprice - off) <= 0.12 AND least(p_size + 4.0, b) - greatest(p_size, a) >= -0.05
QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY abs(p_retailprice - off), s_suppkey) = 1""")
def room_edge_walls(spark, d):
    """The wall that a room's edge lies on: the nearest on its line that it overlaps."""
    e = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    meets = F.least(F.col("p_size") + 4.0, F.col("b")) - F.greatest(F.col("p_size").cast("double"), F.col("a")) >= -0.05
    return joins.nearest_line(e, wall_lines(spark, d), [], ["p_partkey"], "p_retailprice", "off", "s_suppkey", 0.12, extra=meets).select("p_partkey", "s_suppkey", "dist")


ROOMS_OF = f"""{RING}, rooms AS (SELECT n_nationkey AS nation, n_regionkey AS region FROM nation),
p AS (SELECT c_custkey, n_regionkey AS region, c_acctbal * 100 AS px, c_custkey % 97 + 0.5::DOUBLE AS py FROM customer JOIN nation ON n_nationkey = c_nationkey),
hit AS (SELECT c_custkey, nation, sum(CASE WHEN (y > py) <> (y1 > py) THEN CASE WHEN px < x + (py - y) / (y1 - y) * (x1 - x) THEN 1 ELSE 0 END ELSE 0 END) % 2 = 1 AS inside FROM p JOIN rooms USING (region) JOIN ring USING (nation) GROUP BY 1, 2)"""


def inside_rooms(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    home = n.withColumnRenamed("nation", "c_nationkey")
    p = table(spark, d, "customer").join(home, "c_nationkey").select("c_custkey", "region", (F.col("c_acctbal") * 100).alias("px"), (F.col("c_custkey") % 97 + F.lit(0.5).cast("double")).alias("py"))
    return poly.inside(p.join(n, "region"), poly.ring_edges(corners(spark, d), ["nation"], ["s_suppkey"]), ["nation"], ["c_custkey"])


@query(f"WITH {ROOMS_OF} SELECT c_custkey, min(nation) AS room FROM hit WHERE inside GROUP BY c_custkey")
def opening_rooms(spark, d):
    """The room that holds each point, the first of its capture's rooms where several do."""
    return inside_rooms(spark, d).where("inside").groupBy("c_custkey").agg(F.min("nation").alias("room"))


@query(f"WITH {ROOMS_OF} SELECT nation, count(*) FILTER (WHERE inside) AS n, count(*) FILTER (WHERE inside) / count(*) AS share FROM hit GROUP BY nation")
def points_in_rooms(spark, d):
    return inside_rooms(spark, d).groupBy("nation").agg(F.count_if("inside").alias("n"), (F.count_if("inside") / F.count("*")).alias("share"))


@query(f"""WITH {WALLS}, s AS (SELECT s_suppkey, off, unnest(range(0, 21)) AS k, a FROM walls), e AS (SELECT DISTINCT p_retailprice AS u, CAST(p_size AS DOUBLE) AS v FROM part),
hit AS (SELECT s_suppkey, k, EXISTS (SELECT 1 FROM e WHERE abs(u - off) <= 0.4 AND abs(v - (a + k * 0.5::DOUBLE)) <= 0.4) AS h FROM s)
SELECT s_suppkey, count(*) AS samples, count(*) FILTER (WHERE h) AS backed, count(*) FILTER (WHERE h) / count(*) AS share FROM hit GROUP BY s_suppkey""")
def backed_closures(spark, d):
    """How much of each candidate closure evidence stands behind."""
    e = table(spark, d, "part").select(F.col("p_retailprice").alias("u"), F.col("p_size").cast("double").alias("v"))
    return joins.backed_share(wall_lines(spark, d), e, [], "s_suppkey", "off", "a", "b", "u", "v", 0.5, 0.4)


@query("""SELECT o_orderkey, CASE WHEN NOT within THEN 'noise_or_ghost' WHEN inset <= 0.1 AND run >= 1.2 THEN 'wall' WHEN inset <= 0.1 THEN 'tall_furniture' WHEN inset BETWEEN 0.3 AND 0.7 AND run >= 1.2 THEN 'suspected_occluder'
WHEN height <= 1 THEN 'low_furniture' WHEN run < 1.2 THEN 'tall_furniture' ELSE 'noise_or_ghost' END AS label, CASE WHEN NOT within THEN 'beyond_nearest_wall_line' WHEN inset <= 0.1 AND run >= 1.2 THEN 'long_run_aligned_to_manhattan' WHEN inset <= 0.1 THEN 'run_below_min_run'
WHEN inset BETWEEN 0.3 AND 0.7 AND run >= 1.2 THEN 'long_flat_inset_from_wall_line' WHEN height <= 1 THEN 'only_below_furniture_height' WHEN run < 1.2 THEN 'run_below_min_run' ELSE 'unexplained_region' END AS rule
FROM (SELECT o_orderkey, o_orderstatus <> 'P' AS within, o_custkey % 11 / 10.0::DOUBLE AS inset, o_orderkey % 25 / 10.0::DOUBLE AS run, o_totalprice / 200000 AS height FROM orders)""")
def region_labels(spark, d):
    o, n = table(spark, d, "orders"), F.col
    label, rule = rules.region_label(n("o_orderstatus") != "P", n("o_custkey") % 11 / 10.0, n("o_orderkey") % 25 / 10.0, n("o_totalprice") / 200000)
    return o.select("o_orderkey", label.alias("label"), rule.alias("rule"))


@query("""SELECT l_suppkey AS wall, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS off, count(*) AS pieces, round(sum(l_quantity), 4) AS length FROM lineitem GROUP BY 1""")
def weighted_offsets(spark, d):
    """The offset of a cluster of collinear pieces: their mean, weighted by length."""
    t = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("wall"), F.col("l_extendedprice").alias("offset"), F.col("l_quantity").alias("length"))
    return rules.weighted_offset(t, ["wall"]).select("wall", F.round("offset", 4).alias("off"), "pieces", F.round("length", 4).alias("length"))


@query(f"""WITH {CORNERS} SELECT nation, quantile_cont(x, 0.025) AS low, quantile_cont(x, 0.975) AS high, count(*) AS draws FROM corners GROUP BY nation""")
def percentile_intervals(spark, d):
    """The interval of a value from its draws."""
    return corners(spark, d).groupBy("nation").agg(F.percentile("x", F.lit(0.025)).alias("low"), F.percentile("x", F.lit(0.975)).alias("high"), F.count("*").alias("draws"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice AS cost FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) = 1""")
def cheapest_closures(spark, d):
    """The closure of least cost of each gap, the first on ties."""
    best = table(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.struct("o_totalprice", "o_orderkey")).alias("m"))
    return best.select("o_custkey", "m.o_orderkey", F.col("m.o_totalprice").alias("cost"))


@query(f"WITH {CAMERA} SELECT user_id, event_id, x, z FROM camera WHERE x > 60 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 10")
def first_outside(spark, d):
    """The first ten positions of each path that lie outside."""
    return path.first_rows(camera(spark, d).where("x > 60"), ["user_id"], ORDER, 10).select("user_id", "event_id", "x", "z")


@query("""SELECT s_nationkey AS room, count(DISTINCT (floor(s_acctbal / 500), s_suppkey % 10)) * 0.25 / 40.0 AS share FROM supplier GROUP BY 1""")
def footprint_shares(spark, d):
    """Which share of a room's area the cells of its ceiling points cover."""
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("room"), grid.cell("s_acctbal", 500).alias("i"), (F.col("s_suppkey") % 10).alias("j"))
    return grid.occupied(s, "room", "i", "j").groupBy("room").agg((F.count("*") * 0.25 / 40.0).alias("share"))


@query("SELECT o_custkey, avg(abs(o_totalprice - o_custkey * 100)) AS residual, count(*) AS closures FROM orders GROUP BY 1 HAVING count(*) = 1")
def closure_residuals(spark, d):
    """The mean absolute residual of what closes; of single ones, whose mean no order of summation moves."""
    o = table(spark, d, "orders")
    return o.groupBy("o_custkey").agg(F.avg(F.abs(F.col("o_totalprice") - F.col("o_custkey") * 100)).alias("residual"), F.count("*").alias("closures")).where("closures = 1")


# ---- measurements, names and checks ----------------------------------------------------------


@query("SELECT o_orderkey, v AS value, v * (1 - 0.25::DOUBLE) AS ci_low, v * (1 + 0.25::DOUBLE) AS ci_high FROM (SELECT o_orderkey, greatest(o_totalprice - 50000, 0.0) AS v FROM orders)")
def relative_intervals(spark, d):
    m = measures.relative_measure(F.col("o_totalprice") - 50000, 0.25)
    return table(spark, d, "orders").select("o_orderkey", m.alias("m")).select("o_orderkey", "m.*")


@query("SELECT p_partkey, round(sqrt(p_size / 100.0::DOUBLE * (p_size / 100.0::DOUBLE) + 0.03::DOUBLE * 0.03::DOUBLE) * CASE WHEN p_size % 3 > 0 THEN 1 ELSE 2 END, 9) AS half FROM part")
def quadrature_half_widths(spark, d):
    half = measures.quadrature_half_width(F.col("p_size") / 100.0, F.lit(0.03), F.col("p_size") % 3 > 0)
    return table(spark, d, "part").select("p_partkey", F.round(half, 9).alias("half"))


@query("""SELECT p_partkey, replace(replace(replace(replace(p_brand || '<' || p_type || '> & "' || p_size, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS label FROM part""")
def escaped_labels(spark, d):
    raw = F.concat("p_brand", F.lit("<"), "p_type", F.lit('> & "'), F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", measures.escaped_xml(raw).alias("label"))


@query("SELECT hb, count(*) AS n FROM (SELECT greatest(0, least(9, CAST(trunc((l_extendedprice - 5000) / (50000.0::DOUBLE - 5000) * 10) AS BIGINT))) AS hb FROM lineitem) GROUP BY hb")
def height_bins(spark, d):
    b = grid.clipped_bin(F.col("l_extendedprice"), F.lit(5000.0), F.lit(50000.0), 10)
    return table(spark, d, "lineitem").select(b.alias("hb")).groupBy("hb").agg(F.count("*").alias("n"))


@query("SELECT 'c' AS capture_id, CAST(o_orderkey AS VARCHAR) AS frame FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber <= 2 AND l_quantity > 20)")
def frames_without_depth(spark, d):
    """Frames by name against the images there are."""
    named = table(spark, d, "lineitem").where("l_linenumber <= 2 and l_quantity > 20").select(F.col("l_orderkey").cast("string").alias("frame")).distinct().withColumn("depth_ref", F.concat(F.lit("depth/"), "frame", F.lit(".png")))
    f = table(spark, d, "orders").select(F.lit("c").alias("capture_id"), F.col("o_orderkey").cast("string").alias("frame"))
    return bundle.missing_depth(f.join(named, "frame", "left").select("capture_id", "frame", "depth_ref"))


@query("""SELECT p_partkey, unit, scale, CASE WHEN scale IS NOT NULL THEN CAST(least(greatest(round_even(p_retailprice / 100 * scale, 0), 0), 65535) AS INTEGER) END AS mm
FROM (SELECT *, CASE unit WHEN 'mm' THEN 1.0::DOUBLE WHEN 'm' THEN 1000.0::DOUBLE END AS scale FROM (SELECT *, CASE p_size % 3 WHEN 0 THEN 'mm' WHEN 1 THEN 'm' ELSE 'ft' END AS unit FROM part))""")
def depth_units(spark, d):
    unit = F.when(F.col("p_size") % 3 == 0, "mm").when(F.col("p_size") % 3 == 1, "m").otherwise("ft")
    p = table(spark, d, "part").select("p_partkey", "p_retailprice", unit.alias("unit")).withColumn("scale", measures.depth_scale(F.col("unit")))
    return p.select("p_partkey", "unit", "scale", F.when(F.col("scale").isNotNull(), measures.depth_millimetres(F.col("p_retailprice") / 100, F.col("scale"))).alias("mm"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'lidar' WHEN o_orderkey % 2 = 0 THEN 'photos' ELSE 'video' END AS tier FROM orders")
def capture_tiers(spark, d):
    return table(spark, d, "orders").select("o_orderkey", bundle.tier(F.col("o_orderstatus") == "O", F.col("o_orderkey") % 2 == 0).alias("tier"))


@query("SELECT p_partkey, coalesce(TRY_CAST(nullif(trim(CASE p_size % 3 WHEN 0 THEN '  ' WHEN 1 THEN ' ' || p_size || ' ' END), '') AS DOUBLE), 7.5) AS value FROM part")
def optional_values(spark, d):
    raw = F.when(F.col("p_size") % 3 == 0, "  ").when(F.col("p_size") % 3 == 1, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" ")))
    return table(spark, d, "part").select("p_partkey", measures.value_or(raw, 7.5).alias("value"))


@query("""WITH rooms AS (SELECT CAST(n_regionkey AS VARCHAR) AS c, 'r' || n_nationkey AS id, n_nationkey FROM nation), surfaces AS (SELECT CAST(s_suppkey % 5 AS VARCHAR) AS c, 's' || s_suppkey AS id, 'r' || s_nationkey AS room, s_suppkey, s_acctbal FROM supplier)
SELECT c AS capture_id, 'surfaces.room_id' AS "check", 'surfaces refers to unknown rooms ' || room AS message FROM surfaces s WHERE NOT EXISTS (SELECT 1 FROM rooms r WHERE r.c = s.c AND r.id = s.room)
UNION ALL SELECT c, 'openings.room_id', 'openings refers to unknown rooms ' || room FROM surfaces s WHERE NOT EXISTS (SELECT 1 FROM rooms r WHERE r.c = s.c AND r.id = s.room)
UNION ALL SELECT c, 'openings.kind', 'gate is not allowed' FROM surfaces WHERE s_suppkey % 3 = 0
UNION ALL SELECT c, 'openings.width', 'interval of m' || s_suppkey || ' doesn''t hold its value' FROM surfaces WHERE NOT (0 <= s_acctbal AND s_acctbal <= 9000)""")
def schema_checks(spark, d):
    n = F.col
    text = lambda prefix, c: F.concat(F.lit(prefix), n(c).cast("string"))
    fill = lambda df, name: df.select(*[(n(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.TABLES[name]])
    rooms = fill(table(spark, d, "nation").select(n("n_regionkey").cast("string").alias("capture_id"), text("r", "n_nationkey").alias("id")), "rooms")
    s = table(spark, d, "supplier").select("*", (n("s_suppkey") % 5).cast("string").alias("capture_id"), text("s", "s_suppkey").alias("id"), text("r", "s_nationkey").alias("room_id"))
    m = F.struct(text("m", "s_suppkey").alias("id"), F.lit("opening_width").alias("kind"), n("s_acctbal").alias("value"), F.lit("m").alias("unit"), F.lit(0.0).alias("ci_low"), F.lit(9000.0).alias("ci_high"), F.lit("x").alias("method"), F.lit("lidar").alias("tier"))
    doors = s.withColumn("kind", F.when(n("s_suppkey") % 3 == 0, "gate").otherwise("door")).withColumn("surface_id", n("id")).withColumn("width", m)
    return schemas.checks({"rooms": rooms, "surfaces": fill(s, "surfaces"), "openings": fill(doors, "openings")})
