"""Event counts over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket_start(time: Column, minutes: int) -> Column:
    """Floor to a multiple of ``minutes`` since midnight UTC; the grid restarts every day."""
    if minutes < 1:
        raise ValueError(f"bucket_minutes must be at least 1, got {minutes}")
    seconds = F.unix_seconds(time)
    in_day = F.pmod(seconds, F.lit(86400))
    width = minutes * 60
    return F.timestamp_seconds(seconds - in_day + F.floor(in_day / width) * width)


def timeline(events: DataFrame, bucket_minutes: int = 60, time: str = "time") -> DataFrame:
    """(timestamp, count), oldest first; text times are read as ISO, unusable ones skipped."""
    moment = F.col(time)
    if dict(events.dtypes)[time] == "string":
        moment = F.try_to_timestamp(moment)
    return (
        events.select(bucket_start(moment, bucket_minutes).alias("bucket"))
        .where(F.col("bucket").isNotNull())
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy("bucket")
        .select(F.date_format("bucket", "yyyy-MM-dd HH:mm").alias("timestamp"), "count")
    )
