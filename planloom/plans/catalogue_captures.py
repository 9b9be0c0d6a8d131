"""Queries over whole captures: every nation is one, a room of its own size, walked along its diagonal.
Their kernels are iterative geometry, so SQL has no equivalent; known answers test them."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import captures, plan
from .catalogue import query, table

RING = T.ArrayType(T.ArrayType(T.DoubleType()))


def sizes(spark: SparkSession, d: str) -> DataFrame:
    """capture_id, w and h in metres."""
    n = table(spark, d, "nation")
    return n.select(F.concat(F.lit("nation_"), F.col("n_nationkey").cast("string")).alias("capture_id"), (3.0 + F.col("n_nationkey") % 5 * 0.3).alias("w"), (2.6 + F.col("n_regionkey") * 0.25).alias("h"))


def steps(length, step: float, first: float = 0.0):
    """Numbers first, first + step, ... up to the length."""
    k = F.sequence(F.lit(0), F.floor((length - first) / step + 1e-9).cast("int"))
    return F.explode(F.transform(k, lambda i: i * step + first))


def layers(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    s = sizes(spark, d)
    side = lambda along, x, z: s.withColumn("t", steps(F.col(along), 0.02)).select("capture_id", x.cast("double").alias("x"), z.cast("double").alias("z"), F.lit(6).cast("long").alias("support"))
    zero, t = F.lit(0.0), F.col("t")
    walls = side("w", t, zero).unionByName(side("w", t, F.col("h"))).unionByName(side("h", zero, t)).unionByName(side("h", F.col("w"), t))
    floor = s.withColumn("x", steps(F.col("w"), 0.1, 0.05)).withColumn("z", steps(F.col("h"), 0.1, 0.05)).select("capture_id", "x", "z")
    walk = s.withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(29)))).select("capture_id", "seq", (F.col("w") * (0.25 + F.col("seq") / 58)).alias("x"), (F.col("h") * (0.25 + F.col("seq") / 58)).alias("z"))
    high = s.withColumn("x", steps(F.col("w"), 0.1, 0.05)).withColumn("z", steps(F.col("h"), 0.1, 0.05)).select("capture_id", "x", "z", F.lit(2.5).alias("y"))
    return {"wall_cells": walls, "floor_cells": floor, "free_cells": walk.select("capture_id", "x", "z")}, walk, high


def plans(spark: SparkSession, d: str) -> DataFrame:
    found, walk, high = layers(spark, d)
    levels = sizes(spark, d).select("capture_id", F.lit(0.0).alias("floor_y"), F.lit(2.5).alias("ceil_y"))
    return captures.reconstructed(captures.stacked(found, walk, high), levels)


ROOMS = "rooms array<struct<id: string, area: double, area_ci: array<double>, ceiling: struct<status: string, value: double, ci_low: double, ci_high: double>, perimeter: double, observed: double, ring: array<array<double>>>>"


@query()
def room_reconstruction(spark, d):
    p = plans(spark, d).select("capture_id", F.explode(F.from_json("rooms", ROOMS)["rooms"]).alias("r"))
    return p.select("capture_id", "r.id", "r.area", F.col("r.area_ci")[0].alias("area_low"), F.col("r.area_ci")[1].alias("area_high"), F.col("r.ceiling.status").alias("ceiling"), F.col("r.ceiling.value").alias("height"), (F.col("r.observed") / F.col("r.perimeter")).alias("observed_frac"))


@query()
def wall_reconstruction(spark, d):
    kind = "walls array<struct<axis: int, offset: double, start: double, end: double, provenance: string, support: long>>"
    p = plans(spark, d).select("capture_id", F.explode(F.from_json("walls", kind)["walls"]).alias("w"))
    return p.select("capture_id", "w.*")


@query()
def wall_graphs(spark, d):
    kind = "graph struct<counts: struct<L: int, T: int, cross: int, dangling: int>>, evidence struct<total: int, kept: int, explained: int, residual: int>"
    p = plans(spark, d).select("capture_id", F.from_json("walls", kind).alias("w"))
    return p.select("capture_id", "w.graph.counts.*", "w.evidence.*")


@query()
def plan_invariants(spark, d):
    p = plans(spark, d).select("capture_id", F.explode(F.from_json("invariants", "array<struct<name: string, ok: boolean>>")).alias("i"))
    return p.select("capture_id", "i.name", "i.ok")


@query()
def plan_documents(spark, d):
    """The JSON plan of each capture and how many problems its validation finds."""

    def check(batches):
        for b in batches:
            docs = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(plan.problems(json.loads(x))) for x in docs], pa.int32())], ["capture_id", "plan", "problems"])

    p = plans(spark, d).select("capture_id", "plan").mapInArrow(check, "capture_id string, plan string, problems int")
    return p.select("capture_id", F.get_json_object("plan", "$.status").alias("status"), F.sha2("plan", 256).alias("sha256"), "problems")


def two_rooms(spark: SparkSession, d: str) -> DataFrame:
    """Two rooms whose doors face each other, the second placed with a drift of its own."""
    ring = lambda w, h: F.array(*[F.array(a, b) for a, b in ((F.lit(0.0), F.lit(0.0)), (w, F.lit(0.0)), (w, h), (F.lit(0.0), h))])
    w, h = F.col("w"), F.col("h")
    door = lambda room, x, n: F.struct(F.lit(room).alias("room"), F.lit("door").alias("kind"), F.lit(0.9).alias("width"), F.lit(0.0).alias("half"), F.array(x, h / 2).alias("mid"), F.array(F.lit(n), F.lit(0.0)).alias("normal"))
    facing = F.struct(F.struct(ring(w, h).alias("a"), ring(w, h).alias("b")).alias("rooms"), F.array(door("a", w, -1.0), door("b", F.lit(0.0), 1.0)).alias("openings"))
    drift = F.struct(F.struct(ring(w, h).alias("a"), ring(w, h).alias("b")).alias("rooms"), F.struct(F.array(F.lit(0.15), F.lit(0.10), F.lit(0.03)).alias("b")).alias("start"))
    s = sizes(spark, d)
    return s.select("capture_id", F.to_json(facing).alias("doc")).unionByName(s.select(F.concat("capture_id", F.lit("_again")).alias("capture_id"), F.to_json(drift).alias("doc")))


@query()
def stitch_ablation(spark, d):
    """Footprint, residual gap and flags with and without loop closure: one job, a flag apart."""
    return captures.stitched(two_rooms(spark, d)).select("capture_id", "loop_closure", "footprint", "closure_gap", "overlap_ok", "unstitched")
