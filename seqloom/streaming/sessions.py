"""Sessions of an event stream: event-time session windows with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_stream(events: DataFrame, gap_seconds: int, lateness: str = "1 hour") -> DataFrame:
    """user_id, session_start, session_end, event_count, clicks for a (streaming or
    batch) DataFrame events(user_id, time timestamp, action_type).

    A gap of exactly gap_seconds stays within a session, as in the batch operators.
    With a stream, use append mode: a session comes out once the watermark has
    passed its end, and later events of it are dropped.
    """
    return (
        events.withWatermark("time", lateness)
        .groupBy("user_id", F.session_window("time", f"{gap_seconds} seconds"))
        .agg(F.count(F.lit(1)).alias("event_count"), F.count_if(F.col("action_type") == 1).alias("clicks"))
        .select("user_id", F.col("session_window.start").alias("session_start"), (F.col("session_window.end") - F.expr(f"interval {gap_seconds} seconds")).alias("session_end"), "event_count", "clicks")
    )
