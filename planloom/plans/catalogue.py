"""The query catalogue: each operator over the driver's tables, with the SQL that says the same.

Adapters: cloud = lineitem (x price, z quantity, y discount), path = events (by user and time; x value,
z props.k), one-dimensional values = orders.o_totalprice, intervals = orders per customer, lines =
suppliers, points = embeddings.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measures, spatial
from ..operators import components, grid, hist, joins, path, poly, rules, runs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- adapters, in both languages -------------------------------------------------------------

PID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "x", "l_shipdate"]
ORDER = ["ts", "event_id"]


def cloud(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    level = F.floor(F.col("l_discount") * 100 + 0.5).cast("long")
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("z"), level.alias("hb"), grid.cell("l_extendedprice", 1000).alias("i"), grid.cell("l_quantity", 1).alias("j"))


CLOUD = """cloud AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice AS x, l_quantity AS z,
 CAST(floor(l_discount * 100 + 0.5) AS BIGINT) AS hb, CAST(floor(l_extendedprice / 1000) AS BIGINT) AS i, CAST(floor(l_quantity) AS BIGINT) AS j FROM lineitem)"""
CELLS = CLOUD + ", cells AS (SELECT i, j, count(DISTINCT hb) AS support, count(*) AS n FROM cloud GROUP BY i, j)"
HIGH = CELLS + ", high AS (SELECT i, j, n FROM cells WHERE support >= 8)"


def cells(spark: SparkSession, d: str) -> DataFrame:
    return grid.height_support(cloud(spark, d), [], ["i", "j"], "hb")


def high(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d).where("support >= 8").select("i", "j", "n")


def camera(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("user_id", "ts", "event_id", F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("z"))


CAMERA = "camera AS (SELECT user_id, ts, event_id, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS z FROM events)"
STEPS = CAMERA + """, steps AS (SELECT * FROM (SELECT *, lead(x) OVER w AS x1, lead(z) OVER w AS z1 FROM camera
 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE x1 IS NOT NULL)"""


def numbered(about: str, n: str, keep: str) -> str:
    return f"""WITH {CAMERA}, r AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n,
 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM camera) SELECT user_id, event_id, x, z FROM r WHERE {keep}"""


def spans(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of each customer: order day to a length between 10 and 99 days after."""
    o = table(spark, d, "orders")
    start = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    return o.select("o_custkey", "o_orderkey", start.alias("start"), (start + F.col("o_orderkey") % 90 + 10).alias("end"))


SPANS = "spans AS (SELECT o_custkey, o_orderkey, s AS \"start\", s + o_orderkey % 90 + 10 AS \"end\" FROM (SELECT *, CAST(datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS s FROM orders))"
GAPS = SPANS + """, gaps AS (SELECT o_custkey, g0, "start" AS g1 FROM (SELECT *, max("end") OVER (PARTITION BY o_custkey ORDER BY "start", "end", o_orderkey
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g0 FROM spans) WHERE "start" - g0 > 0)"""


# ---- cells -----------------------------------------------------------------------------------


@query(f"WITH {CELLS} SELECT i, j, support FROM cells WHERE support >= 4")
def wall_support(spark, d):
    return cells(spark, d).where("support >= 4").select("i", "j", "support")


@query(f"WITH {CELLS} SELECT support >= 8 AS kept, count(*) AS cells, CAST(sum(n) AS BIGINT) AS points FROM cells GROUP BY 1")
def support_gate(spark, d):
    return grid.support_gate(cells(spark, d), 8).groupBy("kept").agg(F.count("*").alias("cells"), F.sum("n").alias("points"))


@query(f"""WITH {CLOUD}, v AS (SELECT *, CAST(floor(x / 5000.0) AS BIGINT) AS vx, CAST(floor(z / 5.0) AS BIGINT) AS vz FROM cloud)
SELECT vx, hb, vz, l_orderkey, l_linenumber, l_partkey, l_suppkey, x, z FROM (SELECT *, row_number() OVER (PARTITION BY vx, hb, vz
ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, x, l_shipdate, z) AS r FROM v) WHERE r = 1""")
def voxel_first(spark, d):
    c = cloud(spark, d).withColumn("vx", grid.cell("x", 5000)).withColumn("vz", grid.cell("z", 5))
    return grid.voxel_first(c, [], ["vx", "hb", "vz"], PID, ["z"]).drop("l_shipdate")


@query(f"WITH {CLOUD} SELECT DISTINCT i, j FROM cloud WHERE hb <= 1")
def floor_cells(spark, d):
    return grid.occupied(cloud(spark, d).where("hb <= 1"), "i", "j")


@query(f"WITH {CAMERA} SELECT DISTINCT CAST(floor(x / 10.0) AS BIGINT) AS i, CAST(floor(z / 5.0) AS BIGINT) AS j FROM camera")
def free_cells(spark, d):
    return grid.occupied(camera(spark, d).select(grid.cell("x", 10).alias("i"), grid.cell("z", 5).alias("j")), "i", "j")


EVIDENCE = "marks AS (SELECT DISTINCT CAST(floor(l_extendedprice / 25000.0) AS BIGINT) AS i, CAST(floor(l_quantity / 10.0) AS BIGINT) AS j FROM lineitem)"


@query(f"""WITH {CAMERA}, {EVIDENCE}, seen AS (SELECT *, CAST(floor(x / 25.0) AS BIGINT) AS i, CAST(floor(z / 10.0) AS BIGINT) AS j FROM camera)
SELECT user_id, count(*) AS n, count(*) FILTER (WHERE hit) AS inside, count(*) FILTER (WHERE hit) / count(*) AS share
FROM (SELECT user_id, EXISTS (SELECT 1 FROM marks m WHERE abs(m.i - s.i) <= 1 AND abs(m.j - s.j) <= 1) AS hit FROM seen s) GROUP BY user_id""")
def camera_inside_share(spark, d):
    """The evidence is every lineitem point, its price in thousands."""
    c = camera(spark, d).withColumn("i", grid.cell("x", 25)).withColumn("j", grid.cell("z", 10))
    points = table(spark, d, "lineitem").select(grid.cell("l_extendedprice", 25000).alias("i"), grid.cell("l_quantity", 10).alias("j"))
    hit = grid.near(grid.occupied(c, "i", "j"), grid.occupied(points, "i", "j"), []).withColumn("hit", F.lit(1))
    out = c.join(hit, ["i", "j"], "left").groupBy("user_id").agg(F.count("*").alias("n"), F.count("hit").alias("inside"))
    return out.withColumn("share", F.col("inside") / F.col("n"))


@query(f"""WITH {CELLS} SELECT CAST(floor(i / 5.0) AS BIGINT) AS bi, CAST(floor(j / 5.0) AS BIGINT) AS bj, count(*) AS cells, count(*) >= 20 AS dense
FROM cells WHERE support < 8 GROUP BY 1, 2""")
def dense_blobs(spark, d):
    return grid.dense_bins(cells(spark, d).where("support < 8"), [], 5, 20)


@query(f"""WITH {CELLS}, t AS (SELECT support, count(*) FILTER (WHERE support < 8) OVER (PARTITION BY CAST(floor(i / 5.0) AS BIGINT), CAST(floor(j / 5.0) AS BIGINT)) AS c FROM cells)
SELECT count(*) AS total, count(*) FILTER (WHERE support >= 8) AS wall_like, count(*) FILTER (WHERE support < 8 AND c >= 20) AS dense_blobs,
count(*) FILTER (WHERE support < 8 AND c < 20) AS residual, count(*) FILTER (WHERE support >= 8) / count(*) AS wall_like_frac FROM t""")
def evidence_split(spark, d):
    c = cells(spark, d).withColumn("bi", grid.cell("i", 5)).withColumn("bj", grid.cell("j", 5))
    b = grid.dense_bins(c.where("support < 8"), [], 5, 20)
    e, dense = F.col("support") >= 8, F.coalesce("dense", F.lit(False))
    j = c.join(b, ["bi", "bj"], "left").agg(F.count("*").alias("total"), F.count_if(e).alias("wall_like"), F.count_if(~e & dense).alias("dense_blobs"), F.count_if(~e & ~dense).alias("residual"))
    return j.withColumn("wall_like_frac", F.col("wall_like") / F.col("total"))


@query(f"""WITH {HIGH}, r AS (SELECT *, CAST(floor(i / 10.0) AS BIGINT) * 1000 + CAST(floor(j / 10.0) AS BIGINT) AS region FROM high),
m(a, b) AS (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)), k AS (SELECT unnest(range(1, 9)) AS k)
SELECT p.region AS region_a, q.region AS region_b, count(*) AS contacts FROM r p CROSS JOIN m CROSS JOIN k JOIN r q ON q.i = p.i + m.a * k.k AND q.j = p.j + m.b * k.k
WHERE p.region <> q.region GROUP BY 1, 2""")
def region_contacts(spark, d):
    r = high(spark, d).withColumn("region", grid.cell("i", 10) * 1000 + grid.cell("j", 10))
    return grid.contacts(r, [], "region")


@query(f"""WITH {HIGH}, e(a, b, p, q, r, s) AS (VALUES (0, -1, 0, 0, 1, 0), (1, 0, 1, 0, 1, 1), (0, 1, 1, 1, 0, 1), (-1, 0, 0, 1, 0, 0))
SELECT h.i + p AS i0, h.j + q AS j0, h.i + r AS i1, h.j + s AS j1 FROM high h CROSS JOIN e
WHERE NOT EXISTS (SELECT 1 FROM high o WHERE o.i = h.i + a AND o.j = h.j + b)""")
def boundary_edges(spark, d):
    return grid.boundary_edges(high(spark, d), [])


@query(f"""WITH {CELLS} SELECT c.i, c.j, coalesce(max(abs(c.n - o.n)), 0) AS gradient FROM cells c LEFT JOIN cells o
ON (abs(o.i - c.i) = 1 AND o.j = c.j) OR (abs(o.j - c.j) = 1 AND o.i = c.i) GROUP BY 1, 2""")
def neighbour_gradient(spark, d):
    return grid.max_step(cells(spark, d), [], "n")


@query("""SELECT DISTINCT CAST(floor((x0 + t * (x1 - x0)) / 10.0) AS BIGINT) AS i, CAST(floor((z0 + t * (z1 - z0)) / 10.0) AS BIGINT) AS j FROM (
SELECT *, k / greatest(n, 1) AS t FROM (SELECT *, unnest(range(0, n + 1)) AS k FROM (SELECT *, CAST(floor(sqrt((x1 - x0) * (x1 - x0) + (z1 - z0) * (z1 - z0)) / 10.0) AS INTEGER) AS n FROM (
SELECT s_acctbal AS x0, CAST(s_suppkey AS DOUBLE) AS z0, s_acctbal + (s_nationkey - 12) * 20.0 AS x1, s_suppkey + s_nationkey * 7.0 AS z1 FROM supplier))))""")
def ray_carve(spark, d):
    s = table(spark, d, "supplier")
    r = s.select(F.col("s_acctbal").alias("x0"), F.col("s_suppkey").cast("double").alias("z0"), (F.col("s_acctbal") + (F.col("s_nationkey") - 12) * 20.0).alias("x1"), (F.col("s_suppkey") + F.col("s_nationkey") * 7.0).alias("z1"))
    return grid.ray_cells(r, 10.0)


def reached(offsets: str) -> str:
    return f"""WITH RECURSIVE {HIGH}, e AS (SELECT a.i, a.j, b.i AS i2, b.j AS j2 FROM high a JOIN high b ON {offsets}),
r(i, j, i2, j2) AS (SELECT i, j, i, j FROM high UNION SELECT r.i, r.j, e.i2, e.j2 FROM r JOIN e ON e.i = r.i2 AND e.j = r.j2)
SELECT i, j, m // 1000000 AS li, m % 1000000 AS lj FROM (SELECT i, j, min(i2 * 1000000 + j2) AS m FROM r GROUP BY i, j)"""


@query(reached("abs(a.i - b.i) + abs(a.j - b.j) = 1"))
def components4(spark, d):
    return components.label_cells(high(spark, d).drop("n"), [])


@query(reached("abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND (a.i <> b.i OR a.j <> b.j)"))
def components8(spark, d):
    return components.label_cells(high(spark, d).drop("n"), [], diagonal=True)


@query(f"""WITH RECURSIVE {HIGH}, e AS (SELECT a.i, a.j, b.i AS i2, b.j AS j2 FROM high a JOIN high b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1),
r(i, j, i2, j2) AS (SELECT i, j, i, j FROM high UNION SELECT r.i, r.j, e.i2, e.j2 FROM r JOIN e ON e.i = r.i2 AND e.j = r.j2),
l AS (SELECT i, j, min(i2 * 1000000 + j2) AS m FROM r GROUP BY i, j)
SELECT m // 1000000 AS li, m % 1000000 AS lj, count(*) AS cells, max(i) - min(i) + 1 AS height, max(j) - min(j) + 1 AS width, greatest(max(i) - min(i) + 1, max(j) - min(j) + 1) / least(max(i) - min(i) + 1, max(j) - min(j) + 1) AS aspect
FROM l GROUP BY m HAVING count(*) >= 6""")
def region_proposals(spark, d):
    s = components.component_stats(components.label_cells(high(spark, d).drop("n"), [], diagonal=True), [])
    return s.where("cells >= 6").select("li", "lj", "cells", (F.col("i1") - F.col("i0") + 1).alias("height"), (F.col("j1") - F.col("j0") + 1).alias("width"), "aspect")


# ---- histograms and runs ---------------------------------------------------------------------

HIST = """counts AS (SELECT CAST(floor(o_totalprice / 5000.0) AS BIGINT) AS bin, count(*) AS n FROM orders GROUP BY 1),
hist AS (SELECT s.bin, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(a, b)) AS bin FROM (SELECT min(bin) AS a, max(bin) AS b FROM counts)) s LEFT JOIN counts USING (bin)),
smooth AS (SELECT bin, n, CAST(sum(n) OVER (ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS BIGINT) / 5.0 AS smooth FROM hist)"""
PEAKS = HIST + """, peaks AS (SELECT *, lag(smooth) OVER (ORDER BY bin) AS l, lead(smooth) OVER (ORDER BY bin) AS r FROM smooth)"""


def price_hist(spark, d):
    o = table(spark, d, "orders").select(grid.cell("o_totalprice", 5000).alias("bin"))
    return hist.smoothed(hist.dense_counts(o, []), [])


@query(f"WITH {PEAKS} SELECT bin, n, CAST(smooth AS DOUBLE) AS smooth, coalesce(smooth >= l AND smooth > r AND smooth > 0, false) AS is_peak FROM peaks")
def hist_smooth_peaks(spark, d):
    return hist.peaks(price_hist(spark, d), [], "interior")


@query(f"""WITH {PEAKS}, p AS (SELECT bin, smooth FROM peaks WHERE smooth >= coalesce(l, 0) AND smooth >= coalesce(r, 0) AND smooth > 0),
f AS (SELECT bin FROM p ORDER BY smooth DESC, bin LIMIT 1), s AS (SELECT bin FROM p WHERE abs(bin - (SELECT bin FROM f)) >= 20 ORDER BY smooth DESC, bin LIMIT 1),
b AS (SELECT bin, 1 AS rank FROM f UNION ALL SELECT bin, 2 FROM s)
SELECT b.rank, b.bin, count(*) AS support, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) / count(*) AS centroid_cents
FROM b JOIN orders ON abs(o_totalprice - (b.bin + 0.5) * 5000) <= 15000 GROUP BY 1, 2""")
def horizontal_planes(spark, d):
    two = hist.two_planes(hist.peaks(price_hist(spark, d), [], "zero"), [], 20)
    o = table(spark, d, "orders").select("o_totalprice")
    near = o.crossJoin(F.broadcast(two)).where(F.abs(F.col("o_totalprice") - (F.col("bin") + 0.5) * 5000) <= 15000)  # two planes
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long"))
    return near.groupBy("rank", "bin").agg(F.count("*").alias("support"), (cents / F.count("*")).alias("centroid_cents"))


@query(f"""WITH {PEAKS} SELECT bin, n, row_number() OVER (ORDER BY n DESC, bin) AS rank FROM peaks WHERE coalesce(smooth >= l, true) AND coalesce(smooth >= r, true) QUALIFY rank <= 6""")
def ceiling_candidates(spark, d):
    from pyspark.sql import Window

    p = hist.peaks(price_hist(spark, d), [], "open").where("is_peak").orderBy(F.desc("n"), "bin").limit(6)
    return p.select("bin", "n", F.row_number().over(Window.orderBy(F.desc("n"), "bin")).cast("long").alias("rank"))  # six rows


@query("""WITH e AS (SELECT o_totalprice AS v, (SELECT min(o_totalprice) FROM orders) - 0.1 AS lo, (SELECT max(o_totalprice) FROM orders) + 0.1 AS hi FROM orders),
f AS (SELECT *, (lo + 777.7) - lo AS w, floor((v - lo) / ((lo + 777.7) - lo)) AS b FROM e)
SELECT CAST(least(CASE WHEN v < lo + b * w THEN b - 1 WHEN v >= lo + (b + 1) * w THEN b + 1 ELSE b END, ceil((hi - lo) / w) - 1) AS BIGINT) AS bin, count(*) AS n FROM f GROUP BY 1""")
def edge_histogram(spark, d):
    o = table(spark, d, "orders").select(F.col("o_totalprice").alias("v"))
    ends = o.agg((F.min("v") - 0.1).alias("lo"), (F.max("v") + 0.1).alias("hi"))
    b = hist.edge_bin(F.col("v"), F.col("lo"), F.col("hi"), 777.7)
    return o.crossJoin(F.broadcast(ends)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))  # one row of ends


@query("""WITH p AS (SELECT quantile_cont(l_tax + l_discount, 0.02) AS q FROM lineitem), s AS (SELECT l_tax + l_discount AS y FROM lineitem, p WHERE abs(l_tax + l_discount - q) <= 0.035)
SELECT count(*) AS slab, round(max(y), 9) AS top, round(stddev_pop(y), 9) AS rms FROM s""")
def floor_quality(spark, d):
    y = table(spark, d, "lineitem").select((F.col("l_tax") + F.col("l_discount")).alias("y"))
    q = y.agg(F.percentile("y", 0.02).alias("q"))
    slab = y.crossJoin(F.broadcast(q)).where(F.abs(F.col("y") - F.col("q")) <= 0.035)  # one row
    return slab.agg(F.count("*").alias("slab"), F.round(F.max("y"), 9).alias("top"), F.round(F.stddev_pop("y"), 9).alias("rms"))


@query("""WITH l AS (SELECT s_suppkey, s_acctbal * 50 AS o FROM supplier) SELECT s_suppkey, count(*) AS near, median(o_totalprice) AS refined
FROM l JOIN orders ON abs(o_totalprice - o) < 1500 GROUP BY s_suppkey""")
def median_refine(spark, d):
    lines = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") * 50).alias("o"))
    return joins.medians_near(table(spark, d, "orders").select("o_totalprice"), lines, "o_totalprice", "o", "s_suppkey", 1500, 100)


ANGLES = [(k, math.cos(math.radians(k * 0.5)), math.sin(math.radians(k * 0.5))) for k in range(180)]


@query(f"""WITH a(angle, c, s) AS (VALUES {", ".join(f"({k}, {c!r}::DOUBLE, {s!r}::DOUBLE)" for k, c, s in ANGLES)}),
p AS (SELECT l_extendedprice / 1000.0 AS x, l_quantity AS z FROM lineitem),
b AS (SELECT angle, 0 AS axis, CAST(floor((x * c + z * s) / 0.5) AS BIGINT) AS bin FROM p, a UNION ALL SELECT angle, 1, CAST(floor((-x * s + z * c) / 0.5) AS BIGINT) FROM p, a),
h AS (SELECT angle, axis, bin, count(*) AS n FROM b GROUP BY ALL), t AS (SELECT angle, CAST(sum(n * n) AS BIGINT) AS score FROM h GROUP BY angle)
SELECT angle, score FROM t ORDER BY score DESC, angle LIMIT 1""")
def manhattan_angle(spark, d):
    p = table(spark, d, "lineitem").select((F.col("l_extendedprice") / 1000).alias("x"), F.col("l_quantity").alias("z"))
    angles = spark.createDataFrame(ANGLES, "angle int, c double, s double")
    return hist.best_angle(hist.angle_scores(p, [], angles, 0.5), [])


RUNS = f"""{CAMERA}, bins AS (SELECT DISTINCT user_id, CAST(floor(x / 0.5) AS BIGINT) AS bin FROM camera),
brk AS (SELECT *, CASE WHEN coalesce(bin - lag(bin) OVER w > 3, true) THEN 1 ELSE 0 END AS b FROM bins WINDOW w AS (PARTITION BY user_id ORDER BY bin)),
num AS (SELECT *, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY bin ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM brk),
runs AS (SELECT user_id, run, min(bin) AS "first", max(bin) AS "last", count(*) AS occupied, max(bin) - min(bin) + 1 AS length FROM num GROUP BY 1, 2)"""


def user_runs(spark, d):
    b = grid.occupied(camera(spark, d).select("user_id", grid.cell("x", 0.5).alias("bin")), "user_id", "bin")
    return runs.islands(b, ["user_id"], 3)


@query(f"WITH {RUNS} SELECT * FROM runs")
def axis_runs(spark, d):
    return user_runs(spark, d)


@query(f"WITH {RUNS} SELECT user_id, run, occupied / length AS coverage FROM runs WHERE length >= 6")
def run_coverage(spark, d):
    return runs.coverage(user_runs(spark, d).where("length >= 6")).select("user_id", "run", "coverage")


@query(f"""WITH {RUNS} SELECT user_id, "first", "last", length FROM runs QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY length DESC, "first") = 1""")
def longest_run(spark, d):
    return runs.longest(user_runs(spark, d), ["user_id"])


@query(f"""WITH {RUNS} SELECT CAST(sum(CASE WHEN occupied = length THEN length ELSE 0 END) AS BIGINT) AS observed, CAST(sum(CASE WHEN occupied < length THEN length ELSE 0 END) AS BIGINT) AS inferred,
max(CASE WHEN occupied < length THEN length END) AS longest_inferred, count(*) FILTER (WHERE occupied < length AND length > 20) AS over_limit FROM runs""")
def length_accounting(spark, d):
    r, full = user_runs(spark, d), F.col("occupied") == F.col("length")
    n = F.col("length")
    return r.agg(F.sum(F.when(full, n).otherwise(0)).alias("observed"), F.sum(F.when(~full, n).otherwise(0)).alias("inferred"), F.max(F.when(~full, n)).alias("longest_inferred"), F.count_if(~full & (n > 20)).alias("over_limit"))


@query(f"WITH {GAPS} SELECT * FROM gaps")
def gap_sweep(spark, d):
    return runs.reach_gaps(spans(spark, d), ["o_custkey"], 0, ["o_orderkey"])


GAP_LINES = GAPS + """, lined AS (SELECT o_custkey, g0, g1, (o_custkey % 50) * 10 + 0.5 AS off, CAST(g0 % 100 AS DOUBLE) AS a, g0 % 100 + (g1 - g0) / 10.0 AS b FROM gaps)"""


@query(f"""WITH {GAP_LINES}, {STEPS},
hit AS (SELECT o_custkey, g0, count(*) AS crossings FROM (SELECT o_custkey, g0, a, b, z + (x - off) / ((x - off) - (x1 - off)) * (z1 - z) AS pos FROM lined JOIN steps ON (x - off) * (x1 - off) < 0) WHERE pos >= a AND pos <= b GROUP BY 1, 2),
occ AS (SELECT o_custkey, g0, count(*) AS occluders FROM lined JOIN camera ON abs(x - off) < 4 AND z >= a - 0.2 AND z <= b + 0.2 GROUP BY 1, 2),
t AS (SELECT l.*, coalesce(crossings, 0) > 0 AS crossed, coalesce(occluders, 0) AS occluders FROM lined l LEFT JOIN hit USING (o_custkey, g0) LEFT JOIN occ USING (o_custkey, g0))
SELECT o_custkey, g0, g1, crossed, occluders, CASE WHEN crossed AND b - a < 5 THEN 'inferred_dropout' WHEN crossed AND b - a > 25 THEN 'open_space' WHEN crossed THEN 'opening'
WHEN occluders >= 40 THEN 'inferred_occluded' WHEN b - a <= 10 THEN 'inferred_dropout' ELSE 'unknown' END AS kind,
CASE WHEN crossed AND b - a < 5 THEN 'crossed_gap_below_open_min' WHEN crossed AND b - a > 25 THEN 'camera_crossed_wide_gap' WHEN crossed THEN 'camera_path_crosses_gap'
WHEN occluders >= 40 THEN 'furniture_in_front_of_gap' WHEN b - a <= 10 THEN 'short_gap' ELSE 'long_gap_no_evidence' END AS rule FROM t""")
def gap_classify(spark, d):
    g = runs.reach_gaps(spans(spark, d), ["o_custkey"], 0, ["o_orderkey"])
    g = g.select("*", ((F.col("o_custkey") % 50) * 10 + 0.5).alias("off"), (F.col("g0") % 100).cast("double").alias("a"), (F.col("g0") % 100 + (F.col("g1") - F.col("g0")) / 10.0).alias("b"))
    # steps and occluders meet the 50 lines first; gaps join by their line
    lines = g.select("off").distinct()
    c = camera(spark, d)
    s = path.segments(c, ["user_id"], ORDER).withColumn("lo", F.least("x", "x1")).withColumn("hi", F.greatest("x", "x1"))
    met = joins.range_join(lines, s, [], "off", "lo", "hi", 20).withColumn("at", path.crossing(F.col, F.col("off"))).where("at is not null").select("off", "at")
    key = ["o_custkey", "g0"]
    per = lambda points, value, low, high, name: joins.count_between(points, g.withColumn("lo", low).withColumn("hi", high), ["off"], value, "lo", "hi", key, name, 4.0)
    crossings = per(met, "at", F.col("a"), F.col("b"), "crossings")
    band = joins.range_join(c.select("x", "z"), lines.withColumn("lo", F.col("off") - 4).withColumn("hi", F.col("off") + 4), [], "x", "lo", "hi", 8).where(F.abs(F.col("x") - F.col("off")) < 4).select("off", "z")
    occluders = per(band, "z", F.col("a") - 0.2, F.col("b") + 0.2, "occ")
    t = g.join(crossings, key, "left").join(occluders, key, "left").withColumn("crossed", F.coalesce("crossings", F.lit(0)) > 0).withColumn("occluders", F.coalesce("occ", F.lit(0)))
    kind, rule = runs.classify_gap(F.col("crossed"), F.col("occluders"), F.col("b") - F.col("a"), 5, 25, 10, 40)
    return t.select(*key, "g1", "crossed", "occluders", kind.alias("kind"), rule.alias("rule"))


@query(f"""WITH {CELLS}, c AS (SELECT i, count(*) AS n FROM cells WHERE support >= 8 GROUP BY i),
p AS (SELECT s.i AS bin, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(a, b)) AS i FROM (SELECT min(i) AS a, max(i) AS b FROM c)) s LEFT JOIN c USING (i)),
w AS (SELECT *, coalesce(lag(n) OVER o, 0) AS l, coalesce(lead(n) OVER o, 0) AS r, count(*) OVER f AS k, min(n) OVER f AS lo, max(n) OVER f AS hi FROM p WINDOW o AS (ORDER BY bin), f AS (ORDER BY bin ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
SELECT bin, n, n < l AND n < r AND n BETWEEN 1 AND 40 AND n = CASE WHEN k = 7 THEN lo ELSE 0 END AND hi >= 15 AS is_waist FROM w""")
def waist_profile(spark, d):
    p = hist.dense_counts(high(spark, d).select(F.col("i").alias("bin")), [])
    return runs.waists(p, [], 1, 40, 3, 15)


# ---- the camera path -------------------------------------------------------------------------


@query(numbered("cap", "n", "k % greatest(1, CAST(ceil(n / 20.0) AS BIGINT)) = 0"))
def layer_cap(spark, d):
    return path.every(camera(spark, d), ["user_id"], ORDER, path.cap_step(20)).select("user_id", "event_id", "x", "z")


@query(numbered("thin", "n", "k % greatest(1, n // 20) = 0"))
def path_downsample(spark, d):
    return path.every(camera(spark, d), ["user_id"], ORDER, path.thin_step(20)).select("user_id", "event_id", "x", "z")


@query(numbered("stride", "n", "k % 20 = 0"))
def frame_stride(spark, d):
    return path.every(camera(spark, d), ["user_id"], ORDER, 20).select("user_id", "event_id", "x", "z")


@query("SELECT user_id, event_id FROM events WHERE event_id % 60 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 3")
def damage_frame_sample(spark, d):
    return path.sampled_frames(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id", 60, 3)


@query(f"""WITH {STEPS} SELECT user_id, CAST(sum(CAST(floor(sqrt((x1 - x) * (x1 - x) + (z1 - z) * (z1 - z)) / 0.000001 + 0.5) AS BIGINT)) AS BIGINT) AS travel_units, count(*) AS steps FROM steps GROUP BY user_id""")
def camera_travel(spark, d):
    return path.travel(camera(spark, d), ["user_id"], ORDER)


@query(f"""WITH {CAMERA} SELECT user_id, arg_min(x, (ts, event_id)) AS x_first, arg_min(z, (ts, event_id)) AS z_first, arg_max(x, (ts, event_id)) AS x_last, arg_max(z, (ts, event_id)) AS z_last FROM camera GROUP BY user_id""")
def path_endpoints(spark, d):
    return path.endpoints(camera(spark, d), ["user_id"], ORDER)


@query(f"""WITH {STEPS} SELECT user_id, count(*) AS crossings FROM (SELECT user_id, z + (x - 20.0) / ((x - 20.0) - (x1 - 20.0)) * (z1 - z) AS pos FROM steps WHERE (x - 20.0) * (x1 - 20.0) < 0) WHERE pos >= 20 AND pos <= 60 GROUP BY user_id""")
def path_cross_line(spark, d):
    s = path.segments(camera(spark, d), ["user_id"], ORDER).withColumn("at", path.crossing(F.col, F.lit(20.0)))
    return s.where("at >= 20 AND at <= 60").groupBy("user_id").agg(F.count("*").alias("crossings"))


# ---- nearest and band joins ------------------------------------------------------------------


@query("""SELECT o_orderkey, s_suppkey, abs(o_totalprice - s_acctbal * 50) AS dist FROM orders JOIN supplier ON abs(o_totalprice - s_acctbal * 50) < 2000
QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(o_totalprice - s_acctbal * 50), s_suppkey) = 1""")
def nearest_plane_assign(spark, d):
    lines = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") * 50).alias("offset"))
    return joins.nearest_line(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), lines, [], ["o_orderkey"], "o_totalprice", "offset", "s_suppkey", 2000, strict=True)


@query("""WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings)
SELECT p.vec_id, q.vec_id AS camera, (p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b) + (p.c - q.c) * (p.c - q.c) AS d2 FROM e p JOIN e q ON q.vec_id <> p.vec_id
QUALIFY row_number() OVER (PARTITION BY p.vec_id ORDER BY (p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b) + (p.c - q.c) * (p.c - q.c), q.vec_id) = 1""")
def nearest_camera(spark, d):
    """The nearest of all other vectors."""
    e = table(spark, d, "embeddings").select("vec_id", *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("abc")])
    return joins.nearest_point(e, e.withColumnRenamed("vec_id", "camera"), "vec_id", "camera", list("abc"), others=True)


@query(f"""WITH {CAMERA} SELECT s_suppkey, count(*) AS cells FROM supplier JOIN camera ON abs(x - s_acctbal / 20.0) < 2 AND z >= s_nationkey * 2 - 0.2 AND z <= s_nationkey * 2 + 20.2
GROUP BY s_suppkey HAVING count(*) >= 3""")
def band_count(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_acctbal") / 20.0).alias("o")).withColumn("lo", F.col("o") - 2).withColumn("hi", F.col("o") + 2)
    near = joins.range_join(camera(spark, d).select("x", "z"), s, [], "x", "lo", "hi", 4)
    near = near.where((F.abs(F.col("x") - F.col("o")) < 2) & (F.col("z") >= F.col("s_nationkey") * 2 - 0.2) & (F.col("z") <= F.col("s_nationkey") * 2 + 20.2))
    return near.groupBy("s_suppkey").agg(F.count("*").alias("cells")).where("cells >= 3")


LINES = "walls AS (SELECT s_suppkey, 900 + s_suppkey % 100 + 0.37 AS off, CAST(s_nationkey * 2 AS DOUBLE) AS a, CAST(s_nationkey * 2 + 10 AS DOUBLE) AS b FROM supplier)"


def wall_lines(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", (F.lit(900) + F.col("s_suppkey") % 100 + F.lit(0.37).cast("double")).alias("off"), (F.col("s_nationkey") * 2).cast("double").alias("a"), (F.col("s_nationkey") * 2 + 10).cast("double").alias("b"))


@query(f"""WITH {LINES.replace("0.37", "0.37::DOUBLE")} SELECT p_partkey, s_suppkey, off - p_retailprice AS d FROM part JOIN walls ON off - p_retailprice > 0.03 AND off - p_retailprice <= 1.0 AND p_size >= a - 0.1 AND p_size <= b + 0.1
QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY off - p_retailprice, s_suppkey) = 1""")
def perpendicular_snap(spark, d):
    ends = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    w = wall_lines(spark, d).withColumn("lo", F.col("off") - 1.1).withColumn("hi", F.col("off"))
    gap = F.col("off") - F.col("p_retailprice")
    ahead = joins.range_join(ends, w, [], "p_retailprice", "lo", "hi", 1.1).withColumn("d", gap).where("d > 0.03 AND d <= 1.0 AND p_size >= a - 0.1D AND p_size <= b + 0.1D")
    return ahead.groupBy("p_partkey").agg(F.min(F.struct("d", "s_suppkey")).alias("_m")).select("p_partkey", "_m.s_suppkey", "_m.d")


HORIZONTALS = "hs AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS v, p_retailprice AS u0, p_retailprice + 3 AS u1 FROM part)"
NODES = f"""{LINES.replace("0.37", "0.37::DOUBLE")}, {HORIZONTALS}, pairs AS (SELECT s_suppkey, p_partkey, off AS u, v, greatest(0.0::DOUBLE, a - v, v - b) AS dv, greatest(0.0::DOUBLE, u0 - off, off - u1) AS dh FROM walls JOIN hs ON off >= u0 - 1.0 AND off <= u1 + 1.0),
nodes AS (SELECT s_suppkey, p_partkey, u, v, CASE WHEN dv <= 0.05 AND dh <= 0.05 THEN 'inside' WHEN dv <= 0.05 THEN 'extend_horizontal' ELSE 'extend_vertical' END AS kind FROM pairs
WHERE (dv <= 0.05 AND dh <= 0.05) OR (dv <= 0.05 AND dh <= 1.0) OR (dh <= 0.05 AND dv <= 1.0))"""


def nodes(spark, d):
    h = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("v"), F.col("p_retailprice").alias("u0"), (F.col("p_retailprice") + 3).alias("u1"))
    reach = h.withColumn("lo", F.col("u0") - 1.0).withColumn("hi", F.col("u1") + 1.0)
    p = joins.range_join(wall_lines(spark, d), reach, [], "off", "lo", "hi", 5)
    zero = F.lit(0.0)
    p = p.withColumn("dv", F.greatest(zero, F.col("a") - F.col("v"), F.col("v") - F.col("b"))).withColumn("dh", F.greatest(zero, F.col("u0") - F.col("off"), F.col("off") - F.col("u1")))
    inside, across, along = (F.col("dv") <= 0.05) & (F.col("dh") <= 0.05), (F.col("dv") <= 0.05) & (F.col("dh") <= 1.0), (F.col("dh") <= 0.05) & (F.col("dv") <= 1.0)
    kind = F.when(inside, "inside").when(F.col("dv") <= 0.05, "extend_horizontal").otherwise("extend_vertical")
    return p.where(inside | across | along).select("s_suppkey", "p_partkey", F.col("off").alias("u"), "v", kind.alias("kind"))


@query(f"WITH {NODES} SELECT * FROM nodes")
def node_candidates(spark, d):
    return nodes(spark, d)


EDGES = NODES + """, on_line AS (SELECT DISTINCT s_suppkey, u, v FROM nodes), edges AS (SELECT s_suppkey, v AS va, lead(v) OVER (PARTITION BY s_suppkey ORDER BY v) AS vb FROM on_line)"""


def line_edges(spark, d):
    from pyspark.sql import Window

    on = nodes(spark, d).select("s_suppkey", "u", "v").distinct()
    return on.select("s_suppkey", F.col("v").alias("va"), F.lead("v").over(Window.partitionBy("s_suppkey").orderBy("v")).alias("vb"))


@query(f"WITH {EDGES} SELECT s_suppkey, va, vb, vb - va AS length FROM edges WHERE vb - va > 1e-9")
def edge_between_nodes(spark, d):
    return line_edges(spark, d).withColumn("length", F.col("vb") - F.col("va")).where("length > 1e-9")


@query(f"""WITH {EDGES}, ends AS (SELECT s_suppkey, va AS v FROM edges WHERE vb IS NOT NULL UNION ALL SELECT s_suppkey, vb FROM edges WHERE vb IS NOT NULL),
deg AS (SELECT n.s_suppkey, n.v, count(e.v) AS d FROM on_line n LEFT JOIN ends e ON e.s_suppkey = n.s_suppkey AND e.v = n.v GROUP BY 1, 2)
SELECT count(*) FILTER (WHERE d <= 1) AS dangling, count(*) FILTER (WHERE d = 2) AS l, count(*) FILTER (WHERE d = 3) AS t, count(*) FILTER (WHERE d > 3) AS "cross" FROM deg""")
def node_types(spark, d):
    e = line_edges(spark, d)
    full = e.where("vb is not null")
    ends = full.select("s_suppkey", F.col("va").alias("v")).unionByName(full.select("s_suppkey", F.col("vb").alias("v"))).groupBy("s_suppkey", "v").agg(F.count("*").alias("d"))
    deg = e.select("s_suppkey", F.col("va").alias("v")).join(ends, ["s_suppkey", "v"], "left").select(F.coalesce("d", F.lit(0)).alias("d"))
    return deg.agg(F.count_if(F.col("d") <= 1).alias("dangling"), F.count_if(F.col("d") == 2).alias("l"), F.count_if(F.col("d") == 3).alias("t"), F.count_if(F.col("d") > 3).alias("cross"))


@query("""SELECT a.p_type, a.p_partkey AS p_partkey_a, b.p_partkey AS p_partkey_b, a.p_retailprice AS p_retailprice_a, b.p_retailprice AS p_retailprice_b, a.p_brand AS p_brand_a, b.p_brand AS p_brand_b
FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_partkey < b.p_partkey AND a.p_brand <> b.p_brand AND abs(a.p_retailprice - b.p_retailprice) <= 0.06""")
def opening_pairs(spark, d):
    return joins.ordered_pairs(table(spark, d, "part"), "p_partkey", "p_retailprice", 0.06, "p_brand", ["p_type"])


@query("""SELECT least(a, b) AS room_a, greatest(a, b) AS room_b, min(o_orderkey) AS opening FROM (SELECT o_custkey % 60 AS a, o_orderkey % 47 AS b, o_orderkey FROM orders WHERE o_orderstatus = 'P') WHERE a <> b GROUP BY 1, 2""")
def adjacency_pairs(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'P'").select((F.col("o_custkey") % 60).alias("a"), (F.col("o_orderkey") % 47).alias("b"), "o_orderkey")
    return o.where("a <> b").groupBy(F.least("a", "b").alias("room_a"), F.greatest("a", "b").alias("room_b")).agg(F.min("o_orderkey").alias("opening"))


# ---- polygons and transforms -----------------------------------------------------------------

CORNERS = "corners AS (SELECT s_nationkey AS nation, s_suppkey, CAST(round(s_acctbal * 100) AS BIGINT) AS x, s_suppkey % 97 AS y FROM supplier)"
RING = CORNERS + """, ring AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x1, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y1 FROM corners WINDOW w AS (PARTITION BY nation ORDER BY s_suppkey))"""


def corners(spark, d):
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", F.round(F.col("s_acctbal") * 100).cast("long").alias("x"), (F.col("s_suppkey") % 97).alias("y"))


@query(f"WITH {RING} SELECT nation, CAST(CASE WHEN count(*) >= 3 THEN abs(sum(x * y1 - x1 * y)) ELSE 0 END AS BIGINT) AS area2, count(*) AS corners FROM ring GROUP BY nation")
def shoelace_area(spark, d):
    return poly.shoelace(corners(spark, d), ["nation"], ["s_suppkey"])


@query(f"""WITH {RING}, p AS (SELECT c_custkey, c_nationkey AS nation, c_acctbal * 100 AS px, c_custkey % 97 + 0.5::DOUBLE AS py FROM customer)
SELECT c_custkey, nation, CAST(sum(hit) AS BIGINT) AS crossings, CAST(sum(hit) AS BIGINT) % 2 = 1 AS inside FROM (SELECT c_custkey, nation, CASE WHEN (y > py) <> (y1 > py) THEN CASE WHEN px < x + (py - y) / (y1 - y) * (x1 - x) THEN 1 ELSE 0 END ELSE 0 END AS hit FROM p JOIN ring USING (nation)) GROUP BY 1, 2""")
def point_in_polygon(spark, d):
    p = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), (F.col("c_acctbal") * 100).alias("px"), (F.col("c_custkey") % 97 + F.lit(0.5).cast("double")).alias("py"))
    return poly.inside(p, poly.ring_edges(corners(spark, d), ["nation"], ["s_suppkey"]), ["nation"], ["c_custkey"])


@query(f"""WITH t AS (SELECT s_suppkey, s_acctbal / 1000 AS x, s_suppkey / 10.0 AS y, s_nationkey * 0.7 AS th FROM supplier)
SELECT s_suppkey, round(x + cos(th) * 1.5 - sin(th) * -0.5, 6) AS x, round(y + sin(th) * 1.5 + cos(th) * -0.5, 6) AS y, round((th + 2.0 + {math.pi}::DOUBLE) - floor((th + 2.0 + {math.pi}::DOUBLE) / {2 * math.pi}::DOUBLE) * {2 * math.pi}::DOUBLE - {math.pi}::DOUBLE, 6) AS theta FROM t""")
def se2_compose(spark, d):
    s = table(spark, d, "supplier")
    a = spatial.se2(F.col("s_acctbal") / 1000, F.col("s_suppkey") / 10.0, F.col("s_nationkey") * F.lit(0.7).cast("double"))
    b = spatial.se2(F.lit(1.5), F.lit(-0.5), F.lit(2.0))
    c = s.select("s_suppkey", a.alias("a")).select("s_suppkey", spatial.compose(F.col("a"), b).alias("c"))
    return c.select("s_suppkey", *[F.round(f"c.{k}", 6).alias(k) for k in ("x", "y", "theta")])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_quantity - 25) * depth / 100, 6) AS x, round((l_partkey % 192 - 96) * depth / 120, 6) AS y, round(depth, 6) AS z
FROM (SELECT *, least(greatest(round_even(l_extendedprice / 10, 0), 0), 65535) / 1000 AS depth FROM lineitem) WHERE depth > 0 AND depth <= 8""")
def back_project(spark, d):
    t = table(spark, d, "lineitem").withColumn("depth", measures.depth_millimetres(F.col("l_extendedprice"), F.lit(0.1)) / 1000).where("depth > 0 AND depth <= 8")
    x, y, z = spatial.back_project(F.col("l_quantity"), F.col("l_partkey") % 192, F.col("depth"), F.lit(100.0), F.lit(120.0), F.lit(25.0), F.lit(96.0))
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(z, 6).alias("z"))


# ---- colours, damage, checks -----------------------------------------------------------------

SURFACE = """surface AS (SELECT l_suppkey AS surface, CAST(floor(l_quantity / 5.0) AS BIGINT) AS ih, CAST(floor(l_extendedprice / 10000.0) AS BIGINT) AS iu,
CAST(sum(l_partkey % 256) AS BIGINT) AS sum_r, CAST(sum(l_orderkey % 256) AS BIGINT) AS sum_g, CAST(sum((l_partkey + l_orderkey) % 200) AS BIGINT) AS sum_b, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
mean AS (SELECT surface, ih, iu, n, CASE WHEN n >= 3 THEN sum_r / n END AS r, CASE WHEN n >= 3 THEN sum_g / n END AS g, CASE WHEN n >= 3 THEN sum_b / n END AS b FROM surface)"""


def surface_cells(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("surface"), grid.cell("l_quantity", 5).alias("ih"), grid.cell("l_extendedprice", 10000).alias("iu"), (F.col("l_partkey") % 256).alias("r"), (F.col("l_orderkey") % 256).alias("g"), ((F.col("l_partkey") + F.col("l_orderkey")) % 200).alias("b"))
    s = t.groupBy("surface", "ih", "iu").agg(F.sum("r").alias("r"), F.sum("g").alias("g"), F.sum("b").alias("b"), F.count("*").alias("n"))
    return s.select("surface", "ih", "iu", "n", *[F.when(F.col("n") >= 3, F.col(c) / F.col("n")).alias(c) for c in "rgb"])


@query(f"WITH {SURFACE} SELECT * FROM mean")
def surface_cells_mean(spark, d):
    return surface_cells(spark, d)


MASK = SURFACE + """, lum AS (SELECT *, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS lum, (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b, 1.0) AS sat FROM mean WHERE r IS NOT NULL),
grad AS (SELECT p.surface, p.ih, p.iu, coalesce(max(abs(p.lum - q.lum)), 0) AS gradient FROM lum p LEFT JOIN lum q ON p.surface = q.surface AND abs(p.ih - q.ih) + abs(p.iu - q.iu) = 1 GROUP BY 1, 2, 3),
mask AS (SELECT surface, ih, iu, CASE WHEN lum < 95 AND sat < 0.40 THEN 'mold' WHEN r - b > 18 AND lum < 205 THEN 'water_stain' WHEN gradient > 45 THEN 'crack' WHEN gradient > 30 THEN 'peeling_paint' END AS kind FROM lum JOIN grad USING (surface, ih, iu))"""


def masked(spark, d):
    m = surface_cells(spark, d).where("r is not null")
    m = m.withColumn("lum", spatial.luminance(F.col("r"), F.col("g"), F.col("b"))).withColumn("sat", spatial.saturation(F.col("r"), F.col("g"), F.col("b"))).withColumnsRenamed({"ih": "i", "iu": "j"})
    g = grid.max_step(m, ["surface"], "lum")
    out = m.join(g, ["surface", "i", "j"])
    return out.select("surface", F.col("i").alias("ih"), F.col("j").alias("iu"), rules.damage_class(F.col("lum"), F.col("sat"), F.col("r") - F.col("b"), F.col("gradient")).alias("kind"))


@query(f"WITH {MASK} SELECT * FROM mask")
def damage_mask(spark, d):
    return masked(spark, d)


@query(f"""WITH RECURSIVE {MASK}, m AS (SELECT surface, kind, ih AS i, iu AS j FROM mask WHERE kind IS NOT NULL),
e AS (SELECT p.surface, p.kind, p.i, p.j, q.i AS i2, q.j AS j2 FROM m p JOIN m q ON p.surface = q.surface AND p.kind = q.kind AND abs(p.i - q.i) <= 1 AND abs(p.j - q.j) <= 1),
r(surface, kind, i, j, i2, j2) AS (SELECT surface, kind, i, j, i, j FROM m UNION SELECT r.surface, r.kind, r.i, r.j, e.i2, e.j2 FROM r JOIN e ON e.surface = r.surface AND e.kind = r.kind AND e.i = r.i2 AND e.j = r.j2),
l AS (SELECT surface, kind, i, j, min(i2 * 1000000 + j2) AS c FROM r GROUP BY 1, 2, 3, 4),
s AS (SELECT surface, kind, c, count(*) AS cells, greatest(max(i) - min(i) + 1, max(j) - min(j) + 1) * 0.05::DOUBLE AS length, greatest(max(i) - min(i) + 1, max(j) - min(j) + 1) / least(max(i) - min(i) + 1, max(j) - min(j) + 1) AS aspect, count(*) * 0.05::DOUBLE * 0.05::DOUBLE AS area FROM l GROUP BY 1, 2, 3)
SELECT surface, kind, cells, area, length, aspect, 'dmg_' || surface || '_' || kind || '_' || lpad(CAST(row_number() OVER (PARTITION BY surface, kind ORDER BY c) AS VARCHAR), 2, '0') AS id
FROM s WHERE cells >= 3 AND CASE WHEN kind = 'crack' THEN length >= 0.10 AND aspect >= 1.5 ELSE area >= 0.005 END""")
def damage_regions(spark, d):
    from pyspark.sql import Window

    m = masked(spark, d).where("kind is not null").withColumnsRenamed({"ih": "i", "iu": "j"})
    s = components.component_stats(components.label_cells(m, ["surface"], diagonal=True, value=["kind"]), ["surface", "kind"], 0.05)
    s = s.where((F.col("cells") >= 3) & F.when(F.col("kind") == "crack", (F.col("length") >= 0.10) & (F.col("aspect") >= 1.5)).otherwise(F.col("area") >= 0.005))
    k = F.row_number().over(Window.partitionBy("surface", "kind").orderBy("li", "lj"))
    return s.select("surface", "kind", "cells", "area", "length", "aspect", F.concat(F.lit("dmg_"), F.col("surface").cast("string"), F.lit("_"), F.col("kind"), F.lit("_"), F.lpad(k.cast("string"), 2, "0")).alias("id"))


DAMAGES = """damages AS (SELECT l_suppkey AS surface, CASE l_returnflag WHEN 'A' THEN 'mold' WHEN 'N' THEN 'crack' ELSE 'water_stain' END AS kind,
CAST(sum(l_linenumber) AS BIGINT) / 1000.0 AS area, CAST(max(l_linenumber) AS BIGINT) / 4.0 AS length FROM lineitem GROUP BY 1, 2)"""


def damages(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("surface"), F.when(F.col("l_returnflag") == "A", "mold").when(F.col("l_returnflag") == "N", "crack").otherwise("water_stain").alias("kind"), F.col("l_linenumber").cast("long").alias("k"))
    return t.groupBy("surface", "kind").agg((F.sum("k") / F.lit(1000.0)).alias("area"), (F.max("k") / F.lit(4.0)).alias("length"))


@query(f"""WITH {DAMAGES}, rules(kind, flag, measured, least) AS (VALUES ('water_stain', 'MOIST', 'area', 0.30), ('mold', 'MOIST', 'area', 0.30), ('crack', 'STRUCT', 'length', 1.00), ('mold', 'BIO', 'area', 0.50))
SELECT surface, kind, flag FROM damages JOIN rules USING (kind) WHERE CASE measured WHEN 'length' THEN length ELSE area END > least::DOUBLE""")
def concealed_rules(spark, d):
    return rules.concealed_flags(damages(spark, d)).select("surface", "kind", "flag")


@query(f"""WITH {DAMAGES}, tasks(kind, task, unit) AS (VALUES ('water_stain', 'dry_and_repaint', 'm2'), ('mold', 'remediate_mold', 'm2'), ('crack', 'fill_crack', 'm'), ('peeling_paint', 'scrape_and_repaint', 'm2'))
SELECT surface, kind, task, unit, quantity, quantity * 0.75::DOUBLE AS low, quantity * 1.25::DOUBLE AS high FROM (SELECT *, CASE unit WHEN 'm' THEN length ELSE area END AS quantity FROM damages JOIN tasks USING (kind)) WHERE quantity > 0""")
def scope_items(spark, d):
    return rules.scope_items(damages(spark, d)).select("surface", "kind", "task", "unit", "quantity", "low", "high")


@query(f"""WITH {DAMAGES} SELECT kind, count(*) AS n FROM damages GROUP BY kind""")
def counts_by_class(spark, d):
    return damages(spark, d).groupBy("kind").agg(F.count("*").alias("n"))


@query("""SELECT 'order' AS "check", CAST(o_orderkey AS VARCHAR) AS id, 'order: ' || o_orderkey || ' refers to unknown ' || o_custkey AS message FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), 'customer: ' || c_custkey || ' refers to unknown ' || c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)
UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), 'supplier: ' || s_suppkey || ' refers to unknown ' || s_nationkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey > 0)""")
def fk_violations(spark, d):
    n = table(spark, d, "nation")
    a = rules.missing_parent(table(spark, d, "orders"), "o_custkey", table(spark, d, "customer").where("c_acctbal > 0"), "c_custkey", "o_orderkey", "order")
    b = rules.missing_parent(table(spark, d, "customer"), "c_nationkey", n.where("n_regionkey < 3"), "n_nationkey", "c_custkey", "customer")
    c = rules.missing_parent(table(spark, d, "supplier"), "s_nationkey", n.where("n_regionkey > 0"), "n_nationkey", "s_suppkey", "supplier")
    return a.unionByName(b).unionByName(c)


@query("""SELECT 'interval' AS "check", CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE NOT (o_totalprice * 0.5 <= o_custkey * 200.0 AND o_custkey * 200.0 <= o_totalprice * 1.5)""")
def measure_interval_check(spark, d):
    v = F.col("o_custkey") * 200.0
    return rules.violations(table(spark, d, "orders"), "interval", measures.interval_holds(v, F.col("o_totalprice") * 0.5, F.col("o_totalprice") * 1.5), "o_orderkey")


@query("""WITH p AS (SELECT l_suppkey AS wall, CASE l_linenumber % 4 WHEN 0 THEN 'observed' WHEN 1 THEN 'inferred_extension' WHEN 2 THEN 'inferred_occluded' ELSE 'inferred_dropout' END AS provenance, CAST(l_quantity AS BIGINT) // 10 AS length FROM lineitem),
t AS (SELECT wall, provenance, CAST(sum(length) AS BIGINT) AS total FROM p GROUP BY 1, 2)
SELECT wall, provenance, total FROM t QUALIFY row_number() OVER (PARTITION BY wall ORDER BY total DESC, CASE provenance WHEN 'observed' THEN 0 WHEN 'inferred_extension' THEN 1 WHEN 'inferred_occluded' THEN 2 ELSE 3 END) = 1""")
def dominant_provenance(spark, d):
    names = {0: "observed", 1: "inferred_extension", 2: "inferred_occluded"}
    prov = F.lit("inferred_dropout")
    for k, v in names.items():
        prov = F.when(F.col("l_linenumber") % 4 == k, v).otherwise(prov)
    p = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("wall"), prov.alias("provenance"), F.expr("cast(l_quantity as bigint) div 10").alias("length"))
    return rules.dominant_provenance(p, ["wall"])


@query("""SELECT o_custkey % 100 AS room, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN o_orderkey % 100 ELSE 0 END) AS BIGINT) / CAST(sum(o_orderkey % 100) AS BIGINT) AS observed_frac FROM orders GROUP BY 1""")
def perimeter_observed_share(spark, d):
    o, n = table(spark, d, "orders"), F.col("o_orderkey") % 100
    return o.groupBy((F.col("o_custkey") % 100).alias("room")).agg((F.sum(F.when(F.col("o_orderstatus") == "O", n).otherwise(0)) / F.sum(n)).alias("observed_frac"))


@query("""SELECT o_orderkey, value, ci_low, ci_high, (ci_high - ci_low) / 2 AS half FROM (SELECT o_orderkey, o_totalprice AS value, least(o_totalprice, o_custkey * 100.0) AS ci_low, greatest(o_totalprice, o_custkey * 250.0) AS ci_high FROM orders)""")
def clamped_intervals(spark, d):
    m = measures.clamped_measure(F.col("o_totalprice"), F.col("o_custkey") * 100.0, F.col("o_custkey") * 250.0)
    return table(spark, d, "orders").select("o_orderkey", m.alias("m")).select("o_orderkey", "m.*", ((F.col("m.ci_high") - F.col("m.ci_low")) / 2).alias("half"))


@query("""SELECT p_partkey, length, CASE WHEN p_size % 3 > 0 THEN greatest(ci, 0.01::DOUBLE * length) ELSE 0.03::DOUBLE + 0.15::DOUBLE * length END AS half FROM (SELECT p_partkey, p_size, p_retailprice / 100 AS length, p_size / 100.0 AS ci FROM part)""")
def interval_half_widths(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", (F.col("p_retailprice") / 100).alias("length"), (F.col("p_size") / 100.0).alias("ci"))
    return p.select("p_partkey", "length", measures.half_width(F.col("length"), F.col("p_size") % 3 > 0, F.col("ci")).alias("half"))


@query("SELECT s_suppkey, sha256('{\"name\":\"' || s_name || '\",\"nation\":' || s_nationkey || '}') AS hash FROM supplier")
def content_hashes(spark, d):
    doc = F.struct(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return table(spark, d, "supplier").select("s_suppkey", measures.content_hash(doc).alias("hash"))


@query("""WITH s AS (SELECT l_suppkey AS capture, count(*) AS frames, count(*) FILTER (WHERE l_discount > 0.02) / count(*) AS coverage, max(l_extendedprice) / 10000 AS max_depth FROM lineitem GROUP BY 1)
SELECT capture, rule FROM (SELECT capture, unnest([CASE WHEN frames < 560 THEN 'few_frames' END, CASE WHEN coverage < 0.72 THEN 'low_coverage' END, CASE WHEN max_depth NOT BETWEEN 0.2 AND 10.45 THEN 'depth_range' END]) AS rule FROM s) WHERE rule IS NOT NULL""")
def capture_quality(spark, d):
    t = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("capture")).agg(F.count("*").alias("frames"), (F.count_if(F.col("l_discount") > 0.02) / F.count("*")).alias("coverage"), (F.max("l_extendedprice") / 10000).alias("max_depth"))
    found = F.array_compact(F.array(F.when(F.col("frames") < 560, "few_frames"), F.when(F.col("coverage") < 0.72, "low_coverage"), F.when(~F.col("max_depth").between(0.2, 10.45), "depth_range")))
    return t.select("capture", F.explode(found).alias("rule"))


@query("""WITH s(scale) AS (VALUES (0.5), (1.0), (2.0), (10.0)) SELECT CAST(scale AS DOUBLE) AS scale, median(l_quantity) / 18 * CAST(scale AS DOUBLE) AS camera_height, median(l_quantity) / 18 * CAST(scale AS DOUBLE) BETWEEN 1 AND 2 AS plausible FROM lineitem, s GROUP BY 1""")
def depth_unit_check(spark, d):
    m = table(spark, d, "lineitem").agg((F.median("l_quantity") / 18).alias("m"))
    s = spark.createDataFrame([(0.5,), (1.0,), (2.0,), (10.0,)], "scale double")
    return m.crossJoin(F.broadcast(s)).select("scale", (F.col("m") * F.col("scale")).alias("camera_height"), (F.col("m") * F.col("scale")).between(1, 2).alias("plausible"))  # one row by four


@query(f"""WITH {LINES.replace("0.37", "0.37::DOUBLE")}, n AS (SELECT p_retailprice AS u, p_size AS v FROM part)
SELECT s_suppkey, min(v) AS clip_a, max(v) AS clip_b, greatest(0.0, min(v) - a, b - max(v)) AS overshoot FROM walls JOIN n ON abs(u - off) <= 0.05 AND v >= a - 1 AND v <= b + 1 GROUP BY s_suppkey, a, b""")
def clipped_wall_lines(spark, d):
    n = table(spark, d, "part").select(F.col("p_retailprice").alias("u"), F.col("p_size").alias("v"))
    w = wall_lines(spark, d).withColumn("lo", F.col("off") - 0.06).withColumn("hi", F.col("off") + 0.06)
    near = joins.range_join(n, w, [], "u", "lo", "hi", 0.12).where((F.abs(F.col("u") - F.col("off")) <= 0.05) & (F.col("v") >= F.col("a") - 1) & (F.col("v") <= F.col("b") + 1))
    g = near.groupBy("s_suppkey", "a", "b").agg(F.min("v").alias("clip_a"), F.max("v").alias("clip_b"))
    return g.select("s_suppkey", "clip_a", "clip_b", F.greatest(F.lit(0.0), F.col("clip_a") - F.col("a"), F.col("b") - F.col("clip_b")).alias("overshoot"))
