"""Presence and class counts over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_presence(events: DataFrame, time: str, scene: str, label: str, late: str = "1 day") -> DataFrame:
    """Distinct ``scene`` and ``class`` of a stream, each once within the lateness allowed."""
    rows = events.withWatermark(time, late).select(time, F.col(scene).alias("scene"), F.col(label).alias("class"))
    return rows.where("scene is not null and class is not null").dropDuplicatesWithinWatermark(["scene", "class"])


def windowed_frequency(events: DataFrame, time: str, label: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Number of events of each class in tumbling windows; later events are dropped."""
    counted = events.withWatermark(time, late).groupBy(F.window(time, window), F.col(label).alias("class"))
    return counted.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "class", "n")
