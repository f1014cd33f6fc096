"""Streams of speeches: windowed label counts, and the speeches of each author and year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_counts(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """window_start, event_type, events, total value, over event time; rows later than ``late`` are left out of a stream.

    Works on a stream (with the watermark) and on a table (where it has no effect) alike.
    """
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", window).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("events"), F.sum(F.floor("value")).alias("whole_value"))
        .select(F.col("w.start").cast("string").alias("window_start"), "event_type", "events", "whole_value")
    )


def author_timeline(events: DataFrame, late: str = "2 days") -> DataFrame:
    """user_id, month, events: the counts that a timeline of an author's activity is drawn from.

    On a stream the event time is the end of the month, which is a key, so a month's state goes once it is over.
    A month's end is at most 31 days after its events; with that much added to ``late`` no event is left out sooner.
    """
    ends = F.add_months(F.date_trunc("month", "ts"), 1).cast("timestamp")
    counts = events.withColumn("_ends", ends).withWatermark("_ends", f"31 days {late}").groupBy("user_id", "_ends").agg(F.count(F.lit(1)).alias("events"))
    return counts.select("user_id", F.add_months("_ends", -1).cast("timestamp").cast("string").alias("month"), "events")
