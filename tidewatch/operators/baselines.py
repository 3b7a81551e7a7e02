"""Per-entity baselines: mean and sample deviation of a metric.

``per_event`` takes the metric of each single event as one observation.
``hourly`` takes the metric of each entity-hour, which is the useful reading for
counts, rates and distinct counts.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import iso_utc, to_double
from tidewatch.operators.filters import utc
from tidewatch.operators.metrics import entity, metric_column
from tidewatch.registry import MetricDefinition

MIN_OBSERVATIONS = 30  # fixed value
KEYS = ["entity_type", "entity_value", "metric_name", "class_uid"]


def class_rows(events: DataFrame, metric: MetricDefinition) -> DataFrame:
    return events.where((F.col("class_uid") == metric.class_uid) & F.col(metric.entity_field).isNotNull())


def single_event_value(metric: MetricDefinition) -> Column:
    """The metric of one event on its own; a rate needs two events, so it has none."""
    target = F.col(metric.target_field) if metric.target_field else None
    if metric.computation == "count":
        return F.lit(1.0)
    if metric.computation == "rate_per_hour" or target is None:
        return F.lit(None).cast("double")
    if metric.computation == "distinct_field_count":
        return F.when(target.isNotNull(), 1.0).otherwise(0.0)
    return F.coalesce(to_double(target), F.lit(0.0))


def _finish(stats: DataFrame, metric: MetricDefinition, computed_at: Column) -> DataFrame:
    return stats.select(
        F.lit(metric.entity_type).alias("entity_type"),
        "entity_value",
        F.lit(metric.metric_name).alias("metric_name"),
        F.lit(metric.class_uid).alias("class_uid"),
        "mean",
        "stddev",
        "observation_count",
        iso_utc(F.col("first_time")).alias("window_start"),
        iso_utc(F.col("last_time")).alias("window_end"),
        iso_utc(computed_at).alias("computed_at"),
    )


def moment_or_now(value: datetime | None) -> Column:
    return F.current_timestamp() if value is None else F.lit(utc(value))


def per_event_baseline(
    events: DataFrame,
    metric: MetricDefinition,
    min_observations: int = MIN_OBSERVATIONS,
    computed_at: datetime | None = None,
) -> DataFrame:
    stats = (
        class_rows(events, metric)
        .select(entity(metric).alias("entity_value"), "time", single_event_value(metric).alias("x"))
        .groupBy("entity_value")
        .agg(
            F.avg("x").alias("mean"),
            F.stddev_samp("x").alias("stddev"),
            F.count("x").alias("observation_count"),
            F.min("time").alias("first_time"),
            F.max("time").alias("last_time"),
        )
        .where(F.col("observation_count") >= min_observations)
    )
    return _finish(stats, metric, moment_or_now(computed_at))


def hourly_values(events: DataFrame, metric: MetricDefinition) -> DataFrame:
    """(entity_value, hour, value, first_time, last_time) for hours that have events."""
    counts = metric.computation in ("count", "rate_per_hour")
    value = F.count(F.lit(1)).cast("double") if counts else metric_column(metric)
    return (
        class_rows(events, metric)
        .groupBy(entity(metric).alias("entity_value"), F.date_trunc("hour", "time").alias("hour"))
        .agg(value.alias("value"), F.min("time").alias("first_time"), F.max("time").alias("last_time"))
    )


def latest_hour(events: DataFrame, metric: MetricDefinition) -> Column:
    """The newest hour with events of the metric's class, as a scalar subquery."""
    return (
        class_rows(events, metric).agg(F.date_trunc("hour", F.max("time")).alias("hour")).scalar()
    )


def start_of_hour(as_of: datetime) -> datetime:
    return utc(as_of).replace(minute=0, second=0, microsecond=0)


def before_hour(events: DataFrame, as_of: datetime | None) -> DataFrame:
    """Events before the ``as_of`` hour, by a plain comparison that reaches the scan; all of them without one."""
    return events if as_of is None else events.where(F.col("time") < F.lit(start_of_hour(as_of)))


def hourly_baseline(
    events: DataFrame,
    metric: MetricDefinition,
    as_of: datetime | None = None,
    zero_fill: bool = False,
    min_observations: int = MIN_OBSERVATIONS,
    computed_at: datetime | None = None,
) -> DataFrame:
    """Baseline over the hours before ``as_of``; that hour itself never counts.

    ``zero_fill`` also counts the empty hours between an entity's first and last
    hour. They only add zeros, so mean and deviation follow from the filled
    hours' moments and no rows are generated.
    """
    hours = hourly_values(before_hour(events, as_of), metric)
    if as_of is None:
        hours = hours.where(F.col("hour") < latest_hour(events, metric))
    return baseline_of_hours(hours, metric, zero_fill, min_observations, computed_at)


def baseline_of_hours(
    hours: DataFrame,
    metric: MetricDefinition,
    zero_fill: bool = False,
    min_observations: int = MIN_OBSERVATIONS,
    computed_at: datetime | None = None,
) -> DataFrame:
    """The same from rows of ``hourly_values``."""
    stats = hours.groupBy("entity_value").agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("stddev"),
        F.count("value").alias("observation_count"),
        F.min("first_time").alias("first_time"),
        F.max("last_time").alias("last_time"),
        F.min("hour").alias("first_hour"),
        F.max("hour").alias("last_hour"),
    )
    if zero_fill:
        filled = F.col("observation_count")
        span = ((F.unix_seconds("last_hour") - F.unix_seconds("first_hour")) / 3600).cast("bigint") + 1
        spread = F.coalesce(F.when(~F.isnan("stddev"), F.col("stddev")), F.lit(0.0))
        squares = spread * spread * (filled - 1) + F.col("mean") * F.col("mean") * filled * (span - filled) / span
        stats = stats.select(
            "entity_value",
            (F.col("mean") * filled / span).alias("mean"),
            F.when(span > 1, F.sqrt(squares / (span - 1))).alias("stddev"),
            span.alias("observation_count"),
            "first_time",
            "last_time",
        )
    return _finish(stats.where(F.col("observation_count") >= min_observations), metric, moment_or_now(computed_at))


def current_hour_values(events: DataFrame, metric: MetricDefinition, as_of: datetime | None = None) -> DataFrame:
    """The value of each entity in the ``as_of`` hour, keyed for anomaly detection."""
    if as_of is None:
        in_hour = events.where(F.col("time") >= latest_hour(events, metric))
    else:
        start = start_of_hour(as_of)
        in_hour = events.where((F.col("time") >= F.lit(start)) & (F.col("time") < F.lit(start + timedelta(hours=1))))
    return current_of_hours(hourly_values(in_hour, metric), metric)


def current_of_hours(hours: DataFrame, metric: MetricDefinition) -> DataFrame:
    """Rows of ``hourly_values``, keyed for anomaly detection."""
    return _keyed(hours, metric, "value")


def current_event_values(events: DataFrame, metric: MetricDefinition, *carry: str) -> DataFrame:
    """Each single event's value, keyed; ``carry`` keeps further columns such as a row id."""
    rows = class_rows(events, metric).select(
        *carry, entity(metric).alias("entity_value"), single_event_value(metric).alias("value")
    )
    return _keyed(rows, metric, "value", *carry)


def _keyed(rows: DataFrame, metric: MetricDefinition, value: str, *carry: str) -> DataFrame:
    return rows.select(
        *carry,
        F.lit(metric.entity_type).alias("entity_type"),
        "entity_value",
        F.lit(metric.metric_name).alias("metric_name"),
        F.lit(metric.class_uid).alias("class_uid"),
        F.col(value).alias("current_value"),
    )


def upsert_baselines(existing: DataFrame, computed: DataFrame) -> DataFrame:
    """Existing rows whose key was not recomputed, plus all recomputed rows."""
    return existing.join(computed, KEYS, "left_anti").unionByName(computed, allowMissingColumns=True)


def lookup_baselines(keys: DataFrame, baselines: DataFrame) -> DataFrame:
    """The stored baseline of each key; nulls where there is none."""
    return keys.join(baselines, KEYS, "left")
