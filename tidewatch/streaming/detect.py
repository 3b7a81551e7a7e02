"""Streaming timelines, indicator hits, anomalies and deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidewatch.operators.anomalies import detect_anomalies
from tidewatch.operators.events import IDENTITY
from tidewatch.operators.indicators import BROADCAST_BYTES, indicator_hits
from tidewatch.operators.metrics import entity, metric_column
from tidewatch.registry import MetricDefinition

LATE = "10 minutes"


def stream_timeline(events: DataFrame, bucket_minutes: int = 60, late: str = LATE) -> DataFrame:
    """(window_start, count) per tumbling window; rows later than the watermark are dropped.

    The batch grid restarts at midnight, so only widths that divide a day agree with it.
    """
    if bucket_minutes < 1 or 1440 % bucket_minutes:
        raise ValueError(f"bucket_minutes must divide a day, got {bucket_minutes}")
    return (
        events.withWatermark("time", late)
        .groupBy(F.window("time", f"{bucket_minutes} minutes"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.col("window.start").alias("window_start"), "count")
    )


def write_latest(result: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep an updating result as a log of changes, one folder per micro-batch.

    A repeated batch overwrites its own folder. ``read_latest`` gives the state.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        result.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_latest(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The newest value of every key of a change log written by ``write_latest``."""
    values = [c for c in changes.columns if c not in (*keys, "batch")]
    return changes.groupBy(*keys).agg(*[F.max_by(v, "batch").alias(v) for v in values])


def stream_indicator_hits(events: DataFrame, indicators: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Events with indicator matches: stream-static joins, size-checked as in batch.

    Of a large list the stream's scan tests a Bloom filter, so rows that hit nothing reach no shuffle.
    """
    return indicator_hits(events, indicators, max_bytes)


def closed_hours(events: DataFrame, metric: MetricDefinition, late: str = LATE) -> DataFrame:
    """The metric of each entity and hour, keyed for anomaly detection, as each hour closes."""
    counts = metric.computation in ("count", "rate_per_hour")
    rows = events.where((F.col("class_uid") == metric.class_uid) & F.col(metric.entity_field).isNotNull()).withWatermark("time", late)
    hour = F.window("time", "1 hour").alias("window")
    if metric.computation == "distinct_field_count":
        # Each value once an hour and entity, then a plain count: exact, and open hours only are kept as state.
        rows = rows.select(hour, entity(metric).alias("entity_value"), F.col(metric.target_field).alias("target")).dropDuplicates()
        grouped, value = rows.groupBy("window", "entity_value"), F.count("target").cast("double")
    else:
        value = F.count(F.lit(1)).cast("double") if counts else metric_column(metric)
        grouped = rows.groupBy(hour, entity(metric).alias("entity_value"))
    return grouped.agg(value.alias("current_value")).select(
        F.col("window.start").alias("hour"),
        F.lit(metric.entity_type).alias("entity_type"),
        "entity_value",
        F.lit(metric.metric_name).alias("metric_name"),
        F.lit(metric.class_uid).alias("class_uid"),
        "current_value",
    )


def stream_anomalies(events: DataFrame, metric: MetricDefinition, baselines: DataFrame, late: str = LATE) -> DataFrame:
    """Hourly metric of each entity against stored baselines, as each hour closes."""
    return detect_anomalies(closed_hours(events, metric, late), baselines)


def stream_dedup(events: DataFrame, late: str = LATE) -> DataFrame:
    """First copy of each event identity within the watermark."""
    names = {path: f"_k{i}" for i, path in enumerate(IDENTITY)}
    keyed = events.select("*", *[F.col(path).alias(name) for path, name in names.items()])
    return keyed.withWatermark("time", late).dropDuplicatesWithinWatermark(list(names.values())).drop(*names.values())
