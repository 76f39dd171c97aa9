"""Gap sessions of a stream: what ``gap_segments`` does to a table, for events that arrive late and out of order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gap_sessions(events: DataFrame, key: str, time: str, value: str, gap: str = "15 seconds", lateness: str = "1 minute") -> DataFrame:
    """Sessions of events of one key that follow each other within ``gap``: key, start, end, ``n``, and the sum of ``value``.

    On a stream a session comes out once the watermark, ``lateness`` behind the latest event, has passed its end; later events
    are dropped.  On a table every session comes out.  ``end`` lies one gap behind the last event.
    """
    if events.isStreaming:
        events = events.withWatermark(time, lateness)
    s = events.filter(F.col(time).isNotNull()).groupBy(F.col(key), F.session_window(time, gap).alias("w"))
    return s.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def speed_windows(steps: DataFrame, key: str, time: str, step: str, width: str = "10 seconds", slide: str = "5 seconds", lateness: str = "1 minute") -> DataFrame:
    """Metres per key in sliding windows of event time: key, start, end, ``metres``."""
    if steps.isStreaming:
        steps = steps.withWatermark(time, lateness)
    w = steps.groupBy(F.col(key), F.window(time, width, slide).alias("w")).agg(F.sum(step).alias("metres"))
    return w.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "metres")
