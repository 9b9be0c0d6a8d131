"""Files that executors read and write themselves, on whatever file system a folder's URI names."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import SparkSession


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's URI, and the path in it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def put(uri: str, content: bytes) -> None:
    """Writes one file, with the folders above it."""
    system, path = file_system(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path, compression=None) as out:
        out.write(content)


def found(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that a glob pattern names, by Spark's own file systems."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    status = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(path)
    return sorted(s.getPath().toString() for s in status or [])


def copy(spark: SparkSession, source: str, target: str) -> None:
    """One file as it is, by Spark's own file systems."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    a, b = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (source, target))
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf)
