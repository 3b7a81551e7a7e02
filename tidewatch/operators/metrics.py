"""Metric definitions compiled to aggregate expressions, for every entity at once."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import to_double
from tidewatch.registry import MetricDefinition, MetricRegistry


def _count(_: str | None) -> Column:
    return F.count(F.lit(1)).cast("double")


def _distinct(target: str | None, approximate: bool = False) -> Column:
    if not target:
        return F.lit(None).cast("double")
    counted = F.approx_count_distinct(F.col(target)) if approximate else F.count_distinct(F.col(target))
    return counted.cast("double")


def _sum(target: str | None) -> Column:
    if not target:
        return F.lit(None).cast("double")
    return F.coalesce(F.sum(to_double(F.col(target))), F.lit(0.0))


def _rate(_: str | None) -> Column:
    """Events per hour between the first and the last; null for fewer than two events or no span."""
    micros = F.unix_micros(F.max("time")) - F.unix_micros(F.min("time"))
    usable = (F.count("time") >= 2) & (micros > 0)
    return F.when(usable, F.count(F.lit(1)) / (micros / F.lit(3.6e9)))


AGGREGATES: dict[str, Callable[[str | None], Column]] = {
    "count": _count,
    "distinct_field_count": _distinct,
    "sum_field": _sum,
    "rate_per_hour": _rate,
}


def metric_column(metric: MetricDefinition, approximate_distinct: bool = False) -> Column:
    if metric.computation == "distinct_field_count":
        return _distinct(metric.target_field, approximate_distinct)
    return AGGREGATES[metric.computation](metric.target_field)


def entity(metric: MetricDefinition) -> Column:
    return F.col(metric.entity_field).cast("string")


def metric_by_entity(events: DataFrame, metric: MetricDefinition, approximate_distinct: bool = False) -> DataFrame:
    """entity_value, value: one row per non-null entity."""
    return (
        events.where((F.col("class_uid") == metric.class_uid) & F.col(metric.entity_field).isNotNull())
        .groupBy(entity(metric).alias("entity_value"))
        .agg(metric_column(metric, approximate_distinct).alias("value"))
    )


def metric_overall(events: DataFrame, metric_name: str, class_uid: int, registry: MetricRegistry | None = None) -> DataFrame:
    """The metric over all given events; null when there are none."""
    metric = (registry or MetricRegistry.default()).require(metric_name, class_uid)
    return events.where(F.col("class_uid") == class_uid).agg(
        F.when(F.count(F.lit(1)) > 0, metric_column(metric)).alias("value")
    )


def all_metrics(
    events: DataFrame,
    metrics: Iterable[MetricDefinition] | None = None,
    approximate_distinct: bool = False,
) -> DataFrame:
    """Long table (entity_type, entity_value, metric_name, class_uid, value).

    Metrics that share class and entity field come from one aggregation; each
    group scans its class partition and its own columns only.
    """
    groups: dict[tuple, list[MetricDefinition]] = {}
    for metric in metrics or MetricRegistry.default().all():
        groups.setdefault((metric.class_uid, metric.entity_type, metric.entity_field), []).append(metric)
    if not groups:
        raise ValueError("no metrics given")
    parts = []
    for (class_uid, entity_type, field), members in groups.items():
        wide = (
            events.where((F.col("class_uid") == class_uid) & F.col(field).isNotNull())
            .groupBy(F.col(field).cast("string").alias("entity_value"))
            .agg(*[metric_column(m, approximate_distinct).alias(m.metric_name) for m in members])
        )
        parts.append(
            wide.unpivot("entity_value", [m.metric_name for m in members], "metric_name", "value").select(
                F.lit(entity_type).alias("entity_type"),
                "entity_value",
                "metric_name",
                F.lit(class_uid).alias("class_uid"),
                "value",
            )
        )
    return reduce(DataFrame.unionByName, parts)


def distinct_entities(events: DataFrame, entity_field: str) -> DataFrame:
    """Sorted distinct non-null values of a field, as text."""
    value = F.col(entity_field).cast("string")
    return (
        events.where(F.col(entity_field).isNotNull())
        .select(value.alias("entity_value"))
        .distinct()
        .orderBy("entity_value")
    )
