"""Incremental camera path: windowed travel per capture, and sessions, with bounded lateness."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TRAVEL = "user_id long, steps long, travel double, x double, z double"


def sessions(events: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """Runs of events of a user at most `gap` apart: start, end and count."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap), "user_id")
        .agg(F.count("*").alias("n"))
        .select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
    )


def windows(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events and extent of each user's path in tumbling windows."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", size), "user_id")
        .agg(F.count("*").alias("n"), F.min("value").alias("x_min"), F.max("value").alias("x_max"))
        .select("user_id", F.col("window.start").alias("start"), "n", "x_min", "x_max")
    )


def travel(events: DataFrame) -> DataFrame:
    """Running length of each user's path, in order of arrival within a batch sorted by time. State is one
    position and one sum per user."""

    def step(key, batches, state: GroupState):
        steps, length, x, z = state.get if state.exists else (0, 0.0, None, None)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for nx, nz in zip(rows["x"].tolist(), rows["z"].tolist(), strict=True):
            if x is not None:
                steps, length = steps + 1, length + ((nx - x) ** 2 + (nz - z) ** 2) ** 0.5
            x, z = nx, nz
        state.update((steps, length, x, z))
        yield pd.DataFrame({"user_id": [key[0]], "steps": [steps], "travel": [length], "x": [x], "z": [z]})

    path = events.select("user_id", "ts", "event_id", F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("z"))
    return path.groupBy("user_id").applyInPandasWithState(step, TRAVEL, "steps long, travel double, x double, z double", "update", GroupStateTimeout.NoTimeout)
