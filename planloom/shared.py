"""Tables between the steps of an operator, in the folder that driver and executors share."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which every executor and the driver can reach.

    Only where the setting is missing (local sessions) the warehouse folder is used instead.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/planloom-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The frame as Parquet in the shared folder, read again: its lineage ends here, so what follows
    never computes it twice and a lost executor costs no more than the next step."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.planloom_folder = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes the folders of written frames that no later step reads, and lets Spark clean up the
    shuffles of steps that are done (it does so when the driver collects garbage, once Python has let go
    of their frames, some of which are in cycles)."""
    for df in frames:
        jvm, path = df.sparkSession._jvm, df.planloom_folder
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
    if frames:
        gc.collect()
        dropped = getattr(frames[0].sparkSession.sparkContext._gateway._gateway_client, "finalizer_deque", None)
        end = time.monotonic() + 3
        while dropped and time.monotonic() < end:  # py4j tells the driver within a second
            time.sleep(0.05)
        for _ in range(2):  # what the first leaves behind, as listeners still held it, goes with the second
            frames[0].sparkSession._jvm.System.gc()
            gc.collect()
            time.sleep(1)
        frames[0].sparkSession._jvm.System.gc()
