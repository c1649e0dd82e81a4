"""Event-time windows with watermarks, over a stream or a table. Not in the surveyed operators: an addition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, window: Column, keys: list[str], value: str, late: str = "10 minutes") -> DataFrame:
    """n and total of value by event-time window and keys; on a stream, later events are dropped."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    out = events.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def tumbling(events: DataFrame, width: str, keys: list[str], value: str) -> DataFrame:
    return windowed(events, F.window("ts", width), keys, value)


def sliding(events: DataFrame, width: str, step: str, keys: list[str], value: str) -> DataFrame:
    return windowed(events, F.window("ts", width, step), keys, value)


def sessions(events: DataFrame, gap: str, keys: list[str], value: str) -> DataFrame:
    return windowed(events, F.session_window("ts", gap), keys, value)
