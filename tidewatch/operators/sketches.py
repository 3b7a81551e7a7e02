"""Distinct counts from mergeable sketches by entity and day, next to the exact ones of ``metrics``.

A sketch is a few kilobytes whatever it has counted. Sketches of days unite to that of any longer time, so a long look back
reads small stored rows and no event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.baselines import KEYS, class_rows
from tidewatch.operators.metrics import entity
from tidewatch.registry import MetricDefinition

# Of 2^LG_K counters; the standard error is about 0.8 hundredths.
LG_K = 14


def daily_sketches(events: DataFrame, metric: MetricDefinition, lg_k: int = LG_K) -> DataFrame:
    """A sketch of the target field's values by entity and day; entities without any value have an empty one."""
    rows = class_rows(events, metric).select(
        entity(metric).alias("entity_value"), F.to_date("time").alias("day"), F.col(metric.target_field).cast("string").alias("x")
    )
    return (
        rows.groupBy("entity_value", "day")
        .agg(F.hll_sketch_agg("x", lg_k).alias("sketch"))
        .select(
            F.lit(metric.entity_type).alias("entity_type"),
            "entity_value",
            F.lit(metric.metric_name).alias("metric_name"),
            F.lit(metric.class_uid).alias("class_uid"),
            "day",
            "sketch",
        )
    )


def distinct_counts(sketches: DataFrame) -> DataFrame:
    """The estimated number of different values of each key, over all given days."""
    return sketches.groupBy(*KEYS).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("value"))


def distinct_counts_once(events: DataFrame, metric: MetricDefinition, lg_k: int = LG_K) -> DataFrame:
    """(entity_value, value): the same from one pass over events, with nothing stored."""
    rows = class_rows(events, metric).select(entity(metric).alias("entity_value"), F.col(metric.target_field).cast("string").alias("x"))
    return rows.groupBy("entity_value").agg(F.hll_sketch_estimate(F.hll_sketch_agg("x", lg_k)).alias("value"))
