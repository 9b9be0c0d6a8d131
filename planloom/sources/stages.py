"""Saved steps of a run, so that a later run goes on from them: clouds and poses as npz files, the
evidence and the walls as JSON documents. A run's folder has a folder for each capture."""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bundle

PAIRS = "array<array<double>>"


def npz(rows: DataFrame, array: str, columns: list[str], order: list[str], kind: str = "float32") -> DataFrame:
    """(capture_id, content): a compressed npz file of each capture with one array, a row each. A
    capture's cloud is bounded by its voxels."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        np.savez_compressed(out, **{array: part.sort_values(order)[columns].to_numpy(kind)})
        return pd.DataFrame({"capture_id": [part["capture_id"].iloc[0]], "content": [out.getvalue()]})

    return rows.select("capture_id", *dict.fromkeys([*order, *columns])).groupBy("capture_id").applyInPandas(run, "capture_id string, content binary")


def read_npz(spark: SparkSession, pattern: str, array: str, columns: list[str]) -> DataFrame:
    """(capture_id, seq, columns): the rows of an array in every file <capture>/<folder>/<file> of the pattern."""
    files = spark.read.format("binaryFile").load(pattern).select(bundle.capture_of(F.col("path"), 3).alias("capture_id"), "content")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for capture, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.load(io.BytesIO(raw))[array].astype(np.float64).reshape(-1, len(columns))
                yield pa.RecordBatch.from_arrays([pa.array([capture] * len(x), pa.string()), pa.array(np.arange(len(x))), *(pa.array(x[:, k]) for k in range(len(columns)))], ["capture_id", "seq", *columns])

    return files.mapInArrow(run, "capture_id string, seq long, " + ", ".join(f"`{c}` double" for c in columns))


def evidence_documents(layers: dict[str, DataFrame], camera: DataFrame, levels: DataFrame, statistics: DataFrame) -> DataFrame:
    """(capture_id, doc): each capture's layers as one JSON document. Wall cells are a dict of columns,
    floor and free cells and the camera path are pairs."""
    pairs = lambda df, name: df.groupBy("capture_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "z"))), lambda c: F.array(c["x"], c["z"])).alias(name))
    cells = layers["wall_cells"].groupBy("capture_id").agg(F.array_sort(F.collect_list(F.struct("x", "z", "support"))).alias("w"))
    walls = cells.select("capture_id", F.struct(F.col("w.x").alias("x"), F.col("w.z").alias("z"), F.col("w.support").alias("support")).alias("wall_cells"))
    path = camera.groupBy("capture_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "z"))), lambda c: F.array(c["x"], c["z"])).alias("camera_path"))
    counts = statistics.select("capture_id", F.struct(*[c for c in statistics.columns if c != "capture_id"]).alias("statistics"))
    out = levels.select("capture_id", F.struct("floor_y", "ceil_y").alias("levels"))
    for df in (walls, pairs(layers["floor_cells"], "floor_cells"), pairs(layers["free_cells"], "free_cells"), path, counts):
        out = out.join(df, "capture_id", "left")
    return out.select("capture_id", F.to_json(F.struct("capture_id", "levels", "wall_cells", "floor_cells", "free_cells", "camera_path", "statistics")).alias("doc"))


def layer(doc: Column, name: str, fields: list[str]) -> Column:
    """A layer of a JSON document as an array of structs, whether it is a dict of columns or an array of
    rows; an absent one is empty."""
    text = F.get_json_object(doc, f"$.{name}")
    columns = F.from_json(text, ", ".join(f"`{f}` array<double>" for f in fields))
    rows = F.transform(F.from_json(text, PAIRS), lambda r: F.struct(*[r[k].alias(f) for k, f in enumerate(fields)]))
    kind = "array<struct<" + ", ".join(f"`{f}`: double" for f in fields) + ">>"
    by_column = F.arrays_zip(*[columns[f] for f in fields]).cast(kind)
    return F.coalesce(F.when(F.trim(text).startswith("{"), by_column).otherwise(rows.cast(kind)), F.array().cast(kind))


def documents(spark: SparkSession, pattern: str) -> DataFrame:
    """(capture_id, doc) of the JSON files <capture>/<file> of a pattern."""
    raw = spark.read.text(pattern, wholetext=True)
    return raw.select(bundle.capture_of(F.col("_metadata.file_path")).alias("capture_id"), F.col("value").alias("doc"))


def read_evidence(spark: SparkSession, pattern: str) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """The layers, camera path and levels that evidence_documents() saved."""
    docs = documents(spark, pattern)
    rows = lambda name, fields: docs.select("capture_id", F.posexplode(layer(F.col("doc"), name, fields)).alias("seq", "c")).select("capture_id", F.col("seq").cast("long").alias("seq"), "c.*")
    walls = rows("wall_cells", ["x", "z", "support"]).select("capture_id", "x", "z", F.coalesce(F.col("support").cast("long"), F.lit(0)).alias("support"))
    layers = {"wall_cells": walls} | {n: rows(n, ["x", "z"]).drop("seq") for n in ("floor_cells", "free_cells")}
    level = lambda n: F.get_json_object("doc", f"$.levels.{n}").cast("double").alias(n)
    return layers, rows("camera_path", ["x", "z"]), docs.select("capture_id", level("floor_y"), level("ceil_y"))


SEGMENT = "axis int, offset double, start double, end double, provenance string, support long"


def read_walls(spark: SparkSession, pattern: str) -> DataFrame:
    """The wall pieces of saved wall documents: a row each, in order."""
    docs = documents(spark, pattern).select("capture_id", F.posexplode(F.from_json(F.get_json_object("doc", "$.walls"), "array<struct<" + ", ".join(x.replace(" ", ": ", 1) for x in SEGMENT.split(", ")) + ">>")).alias("seq", "w"))
    return docs.select("capture_id", "seq", "w.*")
