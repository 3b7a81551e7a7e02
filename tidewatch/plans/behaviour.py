"""Baselines and anomalies for all entities of a metric in one plan."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.anomalies import detect_anomalies
from tidewatch.operators.baselines import (
    baseline_of_hours,
    current_event_values,
    current_of_hours,
    hourly_values,
    per_event_baseline,
    start_of_hour,
)
from tidewatch.registry import MetricDefinition
from tidewatch.session import settled


def hourly_anomalies(events: DataFrame, metric: MetricDefinition, as_of: datetime | None = None, **options) -> DataFrame:
    """Each entity's ``as_of`` hour (by default the newest one) against its own earlier hours.

    The events are read once, up to the end of that hour, into a settled table of entity-hours, from
    which the hour, the baselines and the current values follow.
    """
    if as_of is not None:
        events = events.where(F.col("time") < F.lit(start_of_hour(as_of) + timedelta(hours=1)))
    hours = settled(hourly_values(events, metric), "entity-hours")
    at = hours.agg(F.max("hour")).scalar() if as_of is None else F.lit(start_of_hour(as_of))
    current = current_of_hours(hours.where(F.col("hour") == at), metric)
    return detect_anomalies(current, baseline_of_hours(hours.where(F.col("hour") < at), metric, **options))


def event_anomalies(events: DataFrame, metric: MetricDefinition, *carry: str) -> DataFrame:
    """Each single event against all events of its entity.

    The baselines are settled first. Events are only shuffled by entity when the
    baselines turn out too large to broadcast.
    """
    baselines = settled(per_event_baseline(events, metric), "event-baselines")
    return detect_anomalies(current_event_values(events, metric, *carry), baselines)
