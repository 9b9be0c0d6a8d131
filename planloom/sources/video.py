"""Frames of a capture's video as a Spark data source. Needs ffmpeg on the executors; without it, or
without a video, a capture has no rows."""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "capture_id string, idx int, height int, width int, rgb binary"
TIME_LIMIT = 1800


def available() -> bool:
    return shutil.which("ffmpeg") is not None


def frame_numbers(count: int, stride: int) -> list[int]:
    """Source frame of each output frame: the first, then every stride-th."""
    return [k * stride for k in range(count)]


class Video(InputPartition):
    def __init__(self, path: str):
        self.path = path


class FrameReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("paths", "").split(",") if p]
        self.stride, self.height, self.width = (int(options.get(k, v)) for k, v in (("stride", 1), ("height", 192), ("width", 256)))

    def partitions(self) -> list[Video]:
        return [Video(p) for p in self.paths]

    def read(self, partition: Video | None) -> Iterator[tuple]:
        if partition is None or not available():  # no videos, or nothing to decode them with
            return
        capture, size = partition.path.rstrip("/").split("/")[-2] if "/" in partition.path else "", self.height * self.width * 3
        picked = rf"select=not(mod(n\,{self.stride})),scale={self.width}:{self.height}"
        run = subprocess.Popen(["ffmpeg", "-v", "error", "-i", partition.path, "-vf", picked, "-vsync", "0", "-f", "rawvideo", "-pix_fmt", "rgb24", "-"], stdout=subprocess.PIPE)
        try:
            k = 0
            while len(raw := run.stdout.read(size)) == size:
                yield (capture, k * self.stride, self.height, self.width, raw)
                k += 1
            run.wait(TIME_LIMIT)
        finally:
            run.kill()


class VideoFrames(DataSource):
    """`spark.read.format("video_frames").option("paths", "a/rgb.mp4,b/rgb.mp4").option("stride", 60)`"""

    @classmethod
    def name(cls) -> str:
        return "video_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FrameReader:
        return FrameReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VideoFrames)


def pixels(frames: DataFrame) -> DataFrame:
    """A row per pixel of frames (SCHEMA): capture_id, idx, u (column), v (row) and r, g, b2."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for capture, idx, height, width, raw in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                rgb = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
                at = np.arange(height * width, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([capture] * len(at)), pa.array(np.full(len(at), idx, np.int32)), pa.array(at % width), pa.array(at // width), *(pa.array(rgb[:, k].copy()) for k in range(3))],
                    ["capture_id", "idx", "u", "v", "r", "g", "b2"],
                )

    return frames.select("capture_id", "idx", "height", "width", "rgb").mapInArrow(run, "capture_id string, idx int, u int, v int, r int, g int, b2 int")


def read(spark: SparkSession, folder: str, stride: int, height: int = 192, width: int = 256) -> DataFrame:
    """The frames of the videos <folder>/rgb.mp4 (folder may be a glob); no rows without ffmpeg or videos."""
    from . import files

    register(spark)
    paths = files.found(spark, f"{folder}/rgb.mp4") if available() else []
    local = ",".join(p.removeprefix("file:") for p in paths)
    return spark.read.format("video_frames").option("paths", local).option("stride", stride).option("height", height).option("width", width).load()
