"""Streams (extensions: the batch engine has no counterpart): sessions of events, and live call-state counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n) of a stream or table of events (user_id, ts); with a watermark where it's a stream."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) in tumbling windows."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def state_counts(calls: DataFrame, late: str = "1 hour") -> DataFrame:
    """Running numbers of call states per sample of a stream of classified calls (sample, state)."""
    return calls.groupBy("sample", "state").agg(F.count("*").alias("n"))
