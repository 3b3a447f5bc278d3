"""Event-time windows over batch tables or streams. These are extensions: see README."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def event_time(df: DataFrame, column: str, late: str | None = None) -> DataFrame:
    """Casts an event time to a timestamp and, on streams, sets how late an event may be."""
    out = df.withColumn(column, F.col(column).cast("timestamp"))
    return out.withWatermark(column, late) if late else out


def windowed(df: DataFrame, time: str, width: str, keys: Sequence[str], aggs: Sequence[Column], slide: str | None = None) -> DataFrame:
    """Tumbling or, with ``slide``, sliding windows: (window_start, window_end, keys..., aggregates)."""
    span = F.window(F.col(time), width, slide) if slide else F.window(F.col(time), width)
    out = df.groupBy(span.alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def sessions(df: DataFrame, time: str, gap: str, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Windows per key that end ``gap`` after their last event."""
    out = df.groupBy(F.session_window(F.col(time), gap).alias("w"), *keys).agg(*aggs)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def first_deliveries(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows once per key; on a stream with a watermark, state is kept for its length only."""
    return df.dropDuplicatesWithinWatermark(list(keys)) if df.isStreaming else df.dropDuplicates(list(keys))
