"""Extensions over event streams: hourly totals and a rate limit, for batch and stream alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATE = "10 minutes"
#: Requests of one key within the trailing window beyond which it is limited.
RATE_LIMIT, RATE_WINDOW, RATE_STEP = 2_000, "5 minutes", "1 minute"


def _timed(events: DataFrame, ts: str) -> DataFrame:
    """Event time as a timestamp of the session's zone, with a watermark on a stream."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return rows.withWatermark(ts, LATE) if events.isStreaming else rows


def hourly(events: DataFrame, ts: str = "ts", value: str = "value") -> DataFrame:
    """(hour, event_type, n, total) by tumbling hours of event time; a stream waits LATE for late events."""
    rows = _timed(events, ts)
    return rows.groupBy(F.window(ts, "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def over_limit(events: DataFrame, key: str = "user_id", ts: str = "ts", most: int = RATE_LIMIT, window: str = RATE_WINDOW, step: str = RATE_STEP) -> DataFrame:
    """(key, window_end, n) where a key has more than ``most`` events in a sliding window."""
    rows = _timed(events, ts)
    return rows.groupBy(F.window(ts, window, step).alias("w"), key).agg(F.count("*").alias("n")).filter(F.col("n") > most).select(key, F.col("w.end").alias("window_end"), "n")
