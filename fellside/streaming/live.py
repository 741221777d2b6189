"""Structured Streaming forms of what the library accumulates: confusion counts, best detections, moving averages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion_stream(pixels: DataFrame) -> DataFrame:
    """Write with outputMode("complete"): the state has at most classes x classes rows."""
    return pixels.groupBy("gt", "pred").agg(F.count("*").alias("n"))


def best_stream(detections: DataFrame) -> DataFrame:
    """Best detection of each (course, number) so far; write with outputMode("update")."""
    return detections.groupBy("course", "number").agg(F.max_by(F.struct("seq", "x", "y", "score"), F.struct("score", -F.col("seq"))).alias("best"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events for each type and window of time; events later than ``late`` are dropped by the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def ema_stream(updates: DataFrame, decay: float) -> DataFrame:
    """``updates``: name, value. The exponential moving average of each name, kept as state between batches."""

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else None
        for f in frames:
            for v in f["value"]:
                now = v if now is None else now * decay + v * (1 - decay)
        state.update((now,))
        yield pd.DataFrame({"name": [key[0]], "ema": [now]})

    return updates.groupBy("name").applyInPandasWithState(run, "name string, ema double", "ema double", "update", "NoTimeout")
