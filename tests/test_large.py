"""Queries over tables that are much larger in one of their sides, against their SQL in DuckDB: no step of them
may hold a row for each pair, or run a kernel for each row."""

import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_catalogue import rows

import planloom.plans.catalogue_kernels  # noqa: F401
import planloom.plans.catalogue_steps  # noqa: F401
from planloom.plans.catalogue import ORACLES, QUERIES


@pytest.fixture()
def tables(tmp_path):
    def write(**frames):
        for name, f in frames.items():
            f.to_parquet(tmp_path / f"{name}.parquet", index=False)
        return str(tmp_path)

    return write


def wanted(folder, name, *used):
    con = duckdb.connect()
    for t in used:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con.execute(ORACLES[name]).df()


def most_rows(df):
    """The most rows that a step of the plan of a collected frame returned."""
    seen = []

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        found = node.metrics().get("numOutputRows")
        if found.isDefined():
            seen.append(found.get().value())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(df._jdf.queryExecution().executedPlan())
    return max(seen)


def held(spark, folder, name, *used):
    """The query's frame, collected, once it is equal to its SQL."""
    df = QUERIES[name](spark, folder)
    got, want = pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns), wanted(folder, name, *used)
    a, b = rows(got), rows(want)
    assert len(a) == len(b) and a == b
    return df


def suppliers(n, nations=25, seed=1):
    r = np.random.default_rng(seed)
    return pd.DataFrame({"s_suppkey": np.arange(n), "s_name": "s", "s_nationkey": r.integers(0, nations, n).astype(np.int32), "s_acctbal": r.integers(-99999, 999999, n) / 100})


def test_equal_boxes_are_measured_once(spark, tables):
    d = tables(supplier=suppliers(6000))
    began = time.monotonic()
    held(spark, d, "box_polygons", "supplier")
    assert time.monotonic() - began < 60  # 840 different boxes; one by one 6,000 take minutes


def orders(n, seed=2):
    r = np.random.default_rng(seed)
    return pd.DataFrame({"o_orderkey": np.arange(n), "o_totalprice": r.integers(-9999, 60000000, n) / 100})


def test_median_refine_makes_no_pairs(spark, tables):
    s, o = suppliers(3000), orders(20000)
    s.loc[5, "s_acctbal"], s.loc[7, "s_acctbal"], o.loc[9, "o_totalprice"], o.loc[11, "o_totalprice"] = None, 1e9, None, np.inf
    o.loc[100:199, "o_totalprice"] = 5000.0
    s.loc[20:29, "s_acctbal"] = [100.0, 70.0, 130.0, 130.00000000001, 69.99999999999999, 0.0, 1e-300, 30.0, -30.0, 30.000000000000004]
    s.loc[41, "s_suppkey"] = 40  # one key, two lines
    df = held(spark, tables(supplier=s, orders=o), "median_refine", "supplier", "orders")
    assert most_rows(df) < 5 * len(o)  # 300,000 pairs


def test_ends_are_those_of_the_comparison():
    from planloom.operators.joins import ends_within

    r = np.random.default_rng(3)
    o = np.concatenate([r.normal(0, 10.0 ** r.integers(-3, 12, 500)), [0.0, -0.0, 1500.0, -1500.0, 1e17, 1e300, np.inf, np.nan]])
    low, high = ends_within(o, 1500)
    known = np.isfinite(o)
    assert np.isnan(low[~known]).all() and np.isnan(high[~known]).all()
    o, low, high = o[known], low[known], high[known]
    ok = lambda v: np.abs(v - o) < 1500
    assert ok(low).all() and ok(high).all() and not ok(np.nextafter(low, -np.inf)).any() and not ok(np.nextafter(high, np.inf)).any()


def test_nearest_plane_assign_makes_no_pairs(spark, tables):
    s, o = suppliers(3000, seed=4), orders(20000, seed=5)
    s.loc[5, "s_acctbal"], s.loc[7, "s_acctbal"], o.loc[9, "o_totalprice"], o.loc[11, "o_totalprice"] = None, 1e9, None, np.inf
    s.loc[100:300, "s_acctbal"] = s.loc[400:600, "s_acctbal"].to_numpy()  # equal lines: the first by key
    s.loc[20:24, "s_acctbal"] = np.nextafter(-5000.0, [-1e9, -5000.0, 0, 1, 2]) + [0, 0, 0, 0, 1e-12]
    o.loc[50:53, "o_totalprice"] = [-249000.5, -250000.0, -251999.0, -253000.0]
    df = held(spark, tables(supplier=s, orders=o), "nearest_plane_assign", "supplier", "orders")
    assert most_rows(df) < 5 * len(o) + 20 * len(s)  # 200,000 pairs and more


def test_nearest_line_where_distances_round_alike(spark):
    from planloom.operators import joins

    offs = [float(np.nextafter(1e-3, 1)), 1e-3, float(np.nextafter(1e-3, 0)), 0.5, -0.25]
    lines = spark.createDataFrame([(9 - k, x) for k, x in enumerate(offs)], "k long, off double")
    at = [2000.0, 1999.75, 0.001, -3.0, 0.3, 0.25, 0.12549999]
    got = joins.nearest_line(spark.createDataFrame(list(enumerate(at)), "p long, v double"), lines, [], ["p"], "v", "off", "k", 2000.0).collect()
    assert {r["p"]: (r["dist"], r["k"]) for r in got} == {p: min((abs(v - x), 9 - k) for k, x in enumerate(offs)) for p, v in enumerate(at)}


def customers(n, seed=6, nations=25):
    r = np.random.default_rng(seed)
    return pd.DataFrame({"c_custkey": np.arange(n), "c_nationkey": r.integers(0, nations, n).astype(np.int32), "c_acctbal": r.integers(-99999, 999999, n) / 100})


def test_opening_host_walls_makes_no_pairs(spark, tables):
    s, c = suppliers(4000, nations=2, seed=7), customers(6000, nations=2)
    s.loc[5, "s_acctbal"], s.loc[6, "s_acctbal"], s.loc[:3, "s_nationkey"] = None, 1e9, [7, 7, 8, 9]
    s.loc[[0, 1], "s_acctbal"] = None  # a room whose walls have no place
    s.loc[100:300, "s_acctbal"] = s.loc[400:600, "s_acctbal"].to_numpy()
    c.loc[:5, "c_acctbal"], c.loc[10:19, "c_nationkey"], c.loc[20, "c_acctbal"] = None, [7, 7, 7, 8, 8, 9, 9, 11, 11, 11], 1e7
    c.loc[31, "c_custkey"] = 30
    s["s_nationkey"], c["c_nationkey"] = s["s_nationkey"].astype(np.int32), c["c_nationkey"].astype(np.int32)
    df = held(spark, tables(supplier=s, customer=c), "opening_host_walls", "supplier", "customer")
    assert most_rows(df) < 5e6  # 12 million pairs


def test_points_in_rooms_makes_no_pairs(spark, tables):
    s, c = suppliers(3000, nations=4, seed=8), customers(20000, nations=5, seed=9)
    n = pd.DataFrame({"n_nationkey": np.arange(5, dtype=np.int32), "n_name": "n", "n_regionkey": np.array([0, 0, 0, 1, 1], np.int32)})
    c.loc[:5, "c_acctbal"] = None
    c.loc[31, "c_custkey"] = 30
    c.loc[40:999, "c_acctbal"] = s["s_acctbal"].to_numpy()[40:1000]  # points on corners' columns
    d = tables(supplier=s, customer=c, nation=n)
    for name in ("points_in_rooms", "opening_rooms", "point_in_polygon"):
        df = held(spark, d, name, "supplier", "customer", "nation")
        assert most_rows(df) < 1e6  # 15 million pairs and more


def test_pairs_of_one_room_are_dealt_to_many_tasks(spark, tables):
    s, c = suppliers(60, nations=1, seed=10), customers(2000, nations=1, seed=11)
    c.loc[:5, "c_acctbal"] = None
    df = held(spark, tables(supplier=s, customer=c), "point_segment_distances", "supplier", "customer")
    assert df.select(F.spark_partition_id()).distinct().count() > 1  # one room, one task before


def test_rounded(spark):
    from planloom.functions import measures

    v = [0.5, -0.5, 1.5, 2.5, -2.5, 0.49999999999999994, 1e300, float("inf"), -1.25, None]
    got = [r["x"] for r in spark.createDataFrame([(x,) for x in v], "v double").select(measures.rounded(F.col("v"), 0).alias("x")).collect()]
    assert got == duckdb.execute("select [round(x, 0) for x in ?::double[]]", [v]).fetchone()[0]


def test_release_drops_the_shuffles_of_steps_that_are_done(spark):
    from planloom.shared import release, written

    found = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    old = found()
    same = lambda batches: batches
    for _ in range(3):
        small = written(spark.range(5))
        written(spark.range(20000).groupBy((F.col("id") % 100).alias("k")).count().mapInArrow(same, "k long, count long"))
        release(small)
        end = time.monotonic() + 8
        while found() - old and time.monotonic() < end:
            time.sleep(0.2)
        assert not found() - old
