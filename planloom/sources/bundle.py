"""Capture bundles: odometry.csv, camera_matrix.csv, meta.json, depth/ and confidence/ images. A folder
holds one capture; a glob reads many at once, told apart by the folder's name."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import measures
from ..shared import written
from . import files, png

POSE = ["timestamp", "x", "y", "z", "qx", "qy", "qz", "qw"]
INTRINSICS = ["fx", "fy", "cx", "cy"]
ROWS, COLS = 192, 256


def capture_of(path: Column, depth: int = 2) -> Column:
    """The name of the folder that a file lies in, `depth` parts from the path's end."""
    return F.element_at(F.split(path, "/"), -depth)


def file_names(spark: SparkSession, folder: str, kind: str, pattern: str = "*.png") -> DataFrame:
    """capture_id, name (of the file without its ending) and content (read only if it is used)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(f"{folder}/{kind}")
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return files.select(capture_of(F.col("path"), 3).alias("capture_id"), name.alias("name"), "content")


def tier_of(spark: SparkSession, folder: str) -> str:
    """The tier of a bundle's folder (or of the bundles of a glob): depth images, else photos, else video."""
    return "lidar" if files.found(spark, f"{folder}/depth") else "photos" if files.found(spark, f"{folder}/photos") else "video"


def resolve(spark: SparkSession, capture: str, roots: list[str]) -> str:
    """The folder of a capture: one that is there, or the only bundle of the id (with or without `cap_`)
    below a folder of one of the roots. None or several are an error."""
    if files.found(spark, f"{capture}/odometry.csv"):
        return capture
    name = capture.removeprefix("cap_")
    hits = sorted({x.removesuffix("/odometry.csv") for r in roots for x in files.found(spark, f"{r}/*/{name}/odometry.csv")})
    if len(hits) != 1:
        raise LookupError(f"capture {capture} is ambiguous: {hits}" if hits else f"capture {capture} not found")
    return hits[0]


def tier(has_depth: Column, has_photos: Column) -> Column:
    return F.when(has_depth, "lidar").when(has_photos, "photos").otherwise("video")


def read_odometry(spark: SparkSession, folder: str) -> DataFrame:
    """The odometry rows of each capture. Columns are found by name, with blanks around names and
    values dropped; empty or missing intrinsics are null."""
    raw = spark.read.text(f"{folder}/odometry.csv", wholetext=True).select(capture_of(F.col("_metadata.file_path")).alias("capture_id"), "value")
    want = ["frame", *POSE, *INTRINSICS]

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for capture, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                lines = [[v.strip() for v in line.split(",")] for line in text.splitlines() if line.strip()]
                place = {n: k for k, n in enumerate(lines[0])}
                missing = [n for n in ("frame", *POSE) if n not in place]
                if missing or len(lines) < 2:
                    raise ValueError(f"{capture}: odometry without {missing or 'rows'}")
                pick = lambda n: [r[place[n]] if n in place and place[n] < len(r) and r[place[n]] else None for r in lines[1:]]  # noqa: E731, B023
                columns = [pa.array(pick("frame"))] + [pa.array([None if v is None else float(v) for v in pick(n)], pa.float64()) for n in want[1:]]
                yield pa.RecordBatch.from_arrays([pa.array([capture] * (len(lines) - 1)), *columns], ["capture_id", *want])

    return raw.mapInArrow(parse, "capture_id string, frame string, " + ", ".join(f"{n} double" for n in want[1:]))


def read_camera_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """capture_id and k_fx, k_fy, k_cx, k_cy of the 3 x 3 matrix."""
    raw = spark.read.text(f"{folder}/camera_matrix.csv", wholetext=True).select(capture_of(F.col("_metadata.file_path")).alias("capture_id"), F.split(F.trim("value"), r"[,\s]+").alias("k"))
    at = {"fx": 0, "fy": 4, "cx": 2, "cy": 5}
    return raw.select("capture_id", *[F.col("k")[i].cast("double").alias(f"k_{n}") for n, i in at.items()])


def read_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Odometry with each frame's image names (null where there is no such file); intrinsics that a row
    lacks come from the camera matrix."""
    o = read_odometry(spark, folder).join(read_camera_matrix(spark, folder), "capture_id", "left")
    for n in INTRINSICS:
        o = o.withColumn(n, F.coalesce(n, f"k_{n}"))
    for kind in ("depth", "confidence"):
        names = file_names(spark, folder, kind).select("capture_id", F.col("name").alias("frame"), F.concat(F.lit(f"{kind}/"), "name", F.lit(".png")).alias(f"{kind}_ref"))
        o = o.join(names, ["capture_id", "frame"], "left")
    return o.drop(*[f"k_{n}" for n in INTRINSICS]).withColumn("idx", F.col("frame").cast("int"))


PIXELS = "capture_id string, name string, height int, width int, values array<int>"


def decoded(files: DataFrame) -> DataFrame:
    """Images as arrays of their samples, row by row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for capture, name, raw in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                image = png.decode(raw)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([capture]), pa.array([name]), pa.array([image.shape[0]], pa.int32()), pa.array([image.shape[1]], pa.int32()), pa.array([image.ravel().astype(np.int32)], pa.list_(pa.int32()))],
                    ["capture_id", "name", "height", "width", "values"],
                )

    return files.mapInArrow(run, PIXELS)


def pixels(images: DataFrame, value: str) -> DataFrame:
    """A row per pixel: capture_id, name, u (column), v (row) and the value."""
    p = images.select("capture_id", "name", "width", F.posexplode("values").alias("at", value))
    return p.select("capture_id", "name", (F.col("at") % F.col("width")).alias("u"), F.floor(F.col("at") / F.col("width")).cast("int").alias("v"), value)


def missing_depth(frames: DataFrame) -> DataFrame:
    """Frames without a depth image, in frame order."""
    return frames.where("depth_ref is null").select("capture_id", "frame").orderBy("capture_id", "frame")


def wrong_shapes(images: DataFrame, rows: int = ROWS, cols: int = COLS) -> DataFrame:
    return images.where((F.col("height") != rows) | (F.col("width") != cols)).select("capture_id", "name", "height", "width")


def normalised_depth(depth: DataFrame, unit: str) -> DataFrame:
    """Depth pixels as whole millimetres, 0 to 65535."""
    scale = measures.depth_scale(F.lit(unit))
    return depth.withColumn("depth", measures.depth_millimetres(F.col("depth"), scale))


def with_confidence(depth: DataFrame, confidence: DataFrame) -> DataFrame:
    """Depth pixels with their confidence; where a frame has none it is 2 everywhere."""
    key = ["capture_id", "name", "u", "v"]
    return depth.join(confidence, key, "left").withColumn("confidence", F.coalesce("confidence", F.lit(2)))


def write_odometry(frames: DataFrame, path: str) -> None:
    """The canonical CSV. A row that lacks a value is an error."""
    cols = ["timestamp", "frame", *POSE[1:], *INTRINSICS]
    held = [F.when(F.col(c).isNull(), F.raise_error(F.concat(F.lit(f"no {c} in frame "), F.coalesce("frame", F.lit("?")))).cast("string")).otherwise(F.col(c).cast("string")).alias(c) for c in cols]
    frames.select("capture_id", *held).write.partitionBy("capture_id").option("header", True).mode("overwrite").csv(path)


META = T.StructType([T.StructField("capture_id", T.StringType()), T.StructField("device", T.StringType()), T.StructField("ios", T.StringType()), T.StructField("captured_at", T.StringType()), T.StructField("rooms_expected", T.IntegerType())])


def read_meta(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(META).option("multiLine", True).json(f"{folder}/meta.json")


# ---- bundles from raw exports ----------------------------------------------------------------


def encoded(images: DataFrame, folder: str, kind: str) -> DataFrame:
    """Writes images (capture_id, name, height, width, values) as PNG files; returns capture_id and name.
    A task that runs again writes the same files."""
    sample = np.uint16 if kind == "depth" else np.uint8

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for capture, name, height, width, values in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                files.put(f"{folder}/{capture}/{kind}/{name}.png", png.encode(np.array(values, sample).reshape(height, width)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["capture_id", "name"])

    return images.select("capture_id", "name", "height", "width", "values").mapInArrow(run, "capture_id string, name string")


def build(spark: SparkSession, raw: str, out: str, capture_id: str | None = None, unit: str = "mm", meta: dict | None = None, shape: tuple[int, int] = (ROWS, COLS)) -> tuple[str, list[str]]:
    """A bundle from a raw export (odometry.csv, depth/ or depth_m/, perhaps confidence/, camera_matrix.csv,
    rgb.mp4 and imu.csv): its folder, and warnings. What can't be used is a ValueError.

    Depth becomes whole millimetres; confidence that is missing is 2 everywhere; a row without
    intrinsics takes those of the matrix. The bundle is read again in the end, so one that is built can be run.
    """
    import json

    capture = capture_id or raw.rstrip("/").rpartition("/")[2]
    target, warnings = f"{out.rstrip('/')}/{capture}", []
    if not files.found(spark, f"{raw}/odometry.csv"):
        raise ValueError(f"no odometry.csv in {raw}")
    kind = next((k for k in ("depth", "depth_m") if files.found(spark, f"{raw}/{k}/*.png")), None)
    if kind is None:
        raise ValueError(f"no depth images in {raw}")
    if kind == "depth_m" and unit == "mm":
        unit = "m"
        warnings.append("depth_m: taken as metres")
    if unit not in ("mm", "m"):
        raise ValueError(f"unknown unit {unit}")
    odometry = written(read_odometry(spark, raw).withColumn("capture_id", F.lit(capture)))
    has_matrix = bool(files.found(spark, f"{raw}/camera_matrix.csv"))
    if has_matrix:
        k = read_camera_matrix(spark, raw).first().asDict()
    else:
        first = odometry.where(" and ".join(f"{n} is not null" for n in INTRINSICS)).orderBy("timestamp", "frame").first()
        if first is None:
            raise ValueError("neither a camera matrix nor intrinsics in the odometry")
        k = {f"k_{n}": first[n] for n in INTRINSICS}
    for n in INTRINSICS:
        odometry = odometry.withColumn(n, F.coalesce(n, F.lit(k[f"k_{n}"])))
    lost = odometry.where(" or ".join(f"{n} is null" for n in ("frame", *POSE))).select("frame").first()
    if lost is not None:
        raise ValueError(f"the odometry row of frame {lost['frame']} lacks a value")

    images = written(decoded(file_names(spark, raw, kind)).withColumn("capture_id", F.lit(capture)))
    bad = wrong_shapes(images, *shape).orderBy("name").first()
    if bad is not None:
        raise ValueError(f"{bad['name']}: {bad['height']} x {bad['width']}, not {shape[0]} x {shape[1]}")
    scale = measures.depth_scale(F.lit(unit))
    depth = images.withColumn("values", F.transform("values", lambda v: measures.depth_millimetres(v, scale)))
    names = written(encoded(depth, out.rstrip("/"), "depth"))
    if files.found(spark, f"{raw}/confidence/*.png"):
        sure = decoded(file_names(spark, raw, "confidence")).withColumn("capture_id", F.lit(capture)).join(names, ["capture_id", "name"], "left_semi")
    else:
        warnings.append("no confidence images: 2 everywhere")
        sure = images.withColumn("values", F.transform("values", lambda v: F.lit(2)))
    encoded(sure, out.rstrip("/"), "confidence").count()
    for name in ("rgb.mp4", "imu.csv"):
        if files.found(spark, f"{raw}/{name}"):
            files.copy(spark, f"{raw}/{name}", f"{target}/{name}")
        elif name == "rgb.mp4":
            warnings.append("no rgb.mp4")

    columns = ["timestamp", "frame", *POSE[1:], *INTRINSICS]

    def one_file(part):
        lines = [",".join(columns), *(",".join(str(v) for v in r) for r in part.sort_values(["timestamp", "frame"])[columns].itertuples(index=False))]
        files.put(f"{target}/odometry.csv", ("\n".join(lines) + "\n").encode())
        return part[["capture_id"]].head(1)

    odometry.groupBy("capture_id").applyInPandas(one_file, "capture_id string").count()  # a capture's poses are one file
    fx, fy, cx, cy = (k[f"k_{n}"] for n in INTRINSICS)
    files.put(f"{target}/camera_matrix.csv", f"{fx},0.0,{cx}\n0.0,{fy},{cy}\n0.0,0.0,1.0\n".encode())
    files.put(f"{target}/meta.json", (json.dumps({"capture_id": capture, "tier": "lidar"} | {n: v for n, v in (meta or {}).items() if v is not None}, indent=2) + "\n").encode())
    missing = [r["frame"] for r in missing_depth(read_frames(spark, target)).limit(4).collect()]
    if missing:
        warnings.append(f"frames without a depth image: {', '.join(missing[:3])}{', ...' if len(missing) > 3 else ''}")
    return target, warnings
