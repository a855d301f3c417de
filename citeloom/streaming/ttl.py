"""Streams of cache entries and citation events.

The batch semantics have no streaming counterpart of their own; these operators give the same results on unbounded input,
with watermarks that bound the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(stream: DataFrame, ts: str) -> DataFrame:
    """Event times without a zone are taken in the session's."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def first_seen(stream: DataFrame, key: str, ts: str, late: str = "30 days") -> DataFrame:
    """The first row of each key within the time to live; state older than the watermark is dropped."""
    return _timed(stream, ts).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows per key in tumbling windows; a window is final once the watermark has passed its end."""
    counts = _timed(stream, ts).withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), key, "n")


def sessions(stream: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Rows per key in sessions that end after a gap."""
    counts = _timed(stream, ts).withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), key, "n")
