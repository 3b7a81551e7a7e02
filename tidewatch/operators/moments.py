"""Mergeable moments of a metric: number, mean, sum of squared distances and span of each entity's day.

Moments of days add up to those of any longer time, so a baseline follows from small stored rows and
only new days are computed from events.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import iso_utc
from tidewatch.operators.baselines import KEYS, MIN_OBSERVATIONS, class_rows, moment_or_now, single_event_value
from tidewatch.operators.metrics import entity
from tidewatch.registry import MetricDefinition


def _keyed(rows: DataFrame, metric: MetricDefinition) -> DataFrame:
    return rows.select(
        F.lit(metric.entity_type).alias("entity_type"),
        "entity_value",
        F.lit(metric.metric_name).alias("metric_name"),
        F.lit(metric.class_uid).alias("class_uid"),
        "day",
        "n",
        "mean",
        "m2",
        "first_time",
        "last_time",
    )


def _moments(value: str, first: str, last: str) -> list[Column]:
    n = F.count(value)
    return [
        n.alias("n"),
        F.avg(value).alias("mean"),
        (F.var_pop(value) * n).alias("m2"),
        F.min(first).alias("first_time"),
        F.max(last).alias("last_time"),
    ]


def daily_event_moments(events: DataFrame, metric: MetricDefinition) -> DataFrame:
    """Moments by entity and day, each single event an observation."""
    rows = class_rows(events, metric).select(
        entity(metric).alias("entity_value"), F.to_date("time").alias("day"), "time", single_event_value(metric).alias("x")
    )
    return _keyed(rows.groupBy("entity_value", "day").agg(*_moments("x", "time", "time")), metric)


def daily_hour_moments(hours: DataFrame, metric: MetricDefinition) -> DataFrame:
    """The same of rows of ``hourly_values``, each entity-hour an observation."""
    rows = hours.withColumn("day", F.to_date("hour"))
    return _keyed(rows.groupBy("entity_value", "day").agg(*_moments("value", "first_time", "last_time")), metric)


def _add(a: Column, b: Column) -> Column:
    """Moments of two disjoint sets together."""
    n = a["n"] + b["n"]
    part = F.when(n > 0, b["n"] / n).otherwise(0.0)
    apart = b["mean"] - a["mean"]
    return F.struct(
        n.alias("n"),
        (a["mean"] + apart * part).alias("mean"),
        (a["m2"] + b["m2"] + apart * apart * a["n"] * part).alias("m2"),
    )


def merged(moments: DataFrame, min_observations: int = MIN_OBSERVATIONS, computed_at: datetime | None = None) -> DataFrame:
    """Baselines of all keys. A key has a row for each day, which are added in order, so results do not vary."""
    number = F.struct(
        "day", "n", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("m2", F.lit(0.0)).alias("m2")
    )
    none = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    days = moments.groupBy(*KEYS).agg(
        F.aggregate(F.array_sort(F.collect_list(number)), none, _add).alias("all"), F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time")
    )
    n, m2 = F.col("all.n"), F.col("all.m2")
    return days.where(n >= min_observations).select(
        *KEYS,
        F.when(n > 0, F.col("all.mean")).alias("mean"),
        F.when(n > 1, F.sqrt(m2 / (n - 1))).alias("stddev"),
        n.alias("observation_count"),
        iso_utc(F.col("first_time")).alias("window_start"),
        iso_utc(F.col("last_time")).alias("window_end"),
        iso_utc(moment_or_now(computed_at)).alias("computed_at"),
    )
