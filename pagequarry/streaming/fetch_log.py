"""Tallies of a fetch log as it grows.

The audit itself is batch; these are the stream forms of its log operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_tallies(events: DataFrame, every: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, users) for each window; ``events``: ts, event_type, user_id.  Later events than ``late`` are left out."""
    timed = events.withWatermark("ts", late)
    counted = timed.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("user_id").alias("users"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n", "users")


def first_fetches(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """Each key once, within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def tallies(events: DataFrame) -> DataFrame:
    """(event_type, n, users) of a whole log, or of a stream in complete or update mode with ``users`` estimated."""
    users = F.approx_count_distinct("user_id") if events.isStreaming else F.count_distinct("user_id")
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), users.alias("users"))
