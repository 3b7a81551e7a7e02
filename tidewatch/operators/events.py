"""Building and flattening the nested event row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.registry import FieldRegistry

# Columns an event table shows first.
DISPLAY_COLUMNS = (
    "time",
    "class_uid",
    "activity_id",
    "severity_id",
    "metadata.log_source",
    "actor.user.name",
    "src_endpoint.ip",
    "dst_endpoint.ip",
)
IDENTITY = ("class_uid", "time", "metadata.log_source", "metadata.original_time")


def event_columns(values: Mapping[str, Column], registry: FieldRegistry) -> list[Column]:
    """Top-level columns of an event: given paths filled in, all others typed nulls."""

    def build(node, path: str) -> Column:
        if isinstance(node, dict):
            return F.struct(*[build(sub, f"{path}.{name}" if path else name).alias(name) for name, sub in node.items()])
        value = values.get(path)
        return (F.lit(None) if value is None else value).cast(node.spark_type)

    return [build(node, name).alias(name) for name, node in registry.tree().items()]


def leaf_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    paths: list[str] = []
    for field in schema.fields:
        here = f"{prefix}{field.name}"
        if isinstance(field.dataType, T.StructType):
            paths += leaf_paths(field.dataType, here + ".")
        else:
            paths.append(here)
    return paths


def flatten_events(events: DataFrame, separator: str = ".") -> DataFrame:
    """One flat column per leaf, named by its path."""
    return events.select(
        *[F.col(path).alias(path.replace(".", separator)) for path in leaf_paths(events.schema)]
    )


def class_projection(events: DataFrame, class_uid: int, registry: FieldRegistry) -> DataFrame:
    """Only the fields that apply to one class, flat."""
    wanted = [d.field_path for d in registry.get_fields_for_class(class_uid)]
    return events.where(F.col("class_uid") == class_uid).select(
        *[F.col(path).alias(path) for path in wanted]
    )


def display_columns(available: list[str], preferred=DISPLAY_COLUMNS) -> list[str]:
    """Preferred columns that exist, else the first eight; with no columns, the preferred ones."""
    if not available:
        return list(preferred)
    return [name for name in preferred if name in available] or list(available[:8])


def display_events(events: DataFrame, preferred=DISPLAY_COLUMNS) -> DataFrame:
    names = display_columns(leaf_paths(events.schema), preferred)
    return events.select(*[F.col(name).alias(name) for name in names])


def dedup_events(events: DataFrame, keep_first_by: list[str] | None = None) -> DataFrame:
    """One row per event identity.

    The aggregate combines before the shuffle, so an identity that fills much of
    the data costs one row per input partition. ``keep_first_by`` names columns
    that decide which copy stays; without it any copy may stay.
    """
    if keep_first_by is None:
        keys = [F.col(path).alias(f"_k{i}") for i, path in enumerate(IDENTITY)]
        keyed = events.select("*", *keys)
        names = [f"_k{i}" for i in range(len(IDENTITY))]
        return keyed.dropDuplicates(names).drop(*names)
    kept = events.groupBy(*[F.col(p).alias(f"_k{i}") for i, p in enumerate(IDENTITY)]).agg(
        F.min_by(F.struct("*"), F.struct(*[F.col(c) for c in keep_first_by])).alias("_row")
    )
    return kept.select("_row.*")
