"""Sessions and first appearances over a stream of events, an extension of the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Events with a watermark, which a stream only takes on a timestamp with a zone."""
    if events.isStreaming and dict(events.dtypes)["ts"] == "timestamp_ntz":
        events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late)


def session_stream(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, begin, end, n_events, total) of closed sessions; events later than ``late``
    behind the newest are left out, and with them the state of their sessions. Works on a
    stream and on a table alike, where every session counts as closed."""
    w = F.session_window("ts", gap)
    s = _timed(events, late).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n_events"), F.sum("value").alias("total"))
    return s.select("user_id", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n_events", "total")


def first_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event id once, the state bounded by the watermark."""
    return _timed(events, late).dropDuplicatesWithinWatermark(["event_id"])


def windowed_counts(events: DataFrame, width: str = "10 minutes", slide: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """(begin, event_type, n) over sliding windows."""
    g = _timed(events, late).groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("begin"), "event_type", "n")
