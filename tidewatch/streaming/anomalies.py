"""Streaming anomalies against each entity's own past, kept as running moments in keyed state.

Hours are aggregated first, before any Python runs, so an entity with very many events sends one row an hour into its
state. State is a few numbers for each entity. An entity that is silent for ``ttl_days`` of event time is forgotten, by a
timer, so a stream that reads its input again forgets at the same places.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewatch.operators.anomalies import THRESHOLD
from tidewatch.operators.baselines import MIN_OBSERVATIONS
from tidewatch.registry import MetricDefinition
from tidewatch.streaming.detect import LATE, closed_hours

TTL_DAYS = 90
# The state store that keyed state with expiry needs.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_OUT = (
    "hour timestamp, entity_type string, entity_value string, metric_name string, class_uid int, current_value double, "
    "baseline_mean double, baseline_stddev double, observation_count bigint, z_score double, is_anomaly boolean"
)


class RunningMoments(StatefulProcessor):
    """Each closed hour of an entity is judged by the hours before it, then joins them."""

    def __init__(self, metric: MetricDefinition, min_observations: int, threshold: float, ttl_ms: int):
        self.metric, self.least, self.threshold, self.ttl_ms = metric, min_observations, threshold, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.past = handle.getValueState("past", "n bigint, mean double, m2 double, forget_at bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n, mean, m2, before = self.past.get() if self.past.exists() else (0, 0.0, 0.0, None)
        out = []
        hours = pd.concat(rows).sort_values("hour")
        for hour, value in zip(hours["hour"], hours["current_value"], strict=True):
            if pd.isna(value) or value in (float("inf"), float("-inf")):
                continue
            if n >= self.least:
                spread = sqrt(m2 / (n - 1)) if n > 1 else 0.0
                apart = value - mean
                flat = 0.0 if apart == 0 else self.threshold + 1.0
                z = apart / spread if spread else flat
                m = self.metric
                out.append((hour, m.entity_type, key[0], m.metric_name, m.class_uid, value, mean, spread, n, z, abs(z) > self.threshold))
            n += 1
            apart = value - mean
            mean += apart / n
            m2 += apart * (value - mean)
        forget_at = int(hours["hour"].iloc[-1].value // 1_000_000) + self.ttl_ms
        if before is not None:
            forget_at = max(forget_at, before)
        if forget_at != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(forget_at)
        self.past.update((n, mean, m2, forget_at))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.past.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_running_anomalies(
    events: DataFrame,
    metric: MetricDefinition,
    min_observations: int = MIN_OBSERVATIONS,
    threshold: float = THRESHOLD,
    late: str = LATE,
    ttl_days: int = TTL_DAYS,
) -> DataFrame:
    """Every closed hour of every entity that has enough earlier hours, with its z-score among them."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    hours = closed_hours(events, metric, late).select("hour", "entity_value", F.col("current_value"))
    processor = RunningMoments(metric, min_observations, threshold, ttl_days * 86_400_000)
    return hours.groupBy("entity_value").transformWithStateInPandas(processor, _OUT, outputMode="Append", timeMode="EventTime")
