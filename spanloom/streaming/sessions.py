"""Gap sessions of events, for a stream or a table alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """events: (user_id, ts: TIMESTAMP, ...). One row a session: its first and last event and how many. late: a stream's watermark."""
    if late:
        events = events.withWatermark("ts", late)
    made = events.groupBy("user_id", F.session_window("ts", gap)).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))
    return made.select("user_id", F.unix_micros("first").alias("start_us"), F.unix_micros("last").alias("end_us"), "n")
