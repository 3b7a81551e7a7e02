"""Filter specifications compiled to one predicate that Catalyst can push down."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.registry import FieldRegistry

# The nine filter operators.
OPERATORS = ("eq", "ne", "gt", "lt", "gte", "lte", "contains", "is_null", "not_null")


@dataclass(frozen=True)
class FieldFilter:
    """One condition on one field."""

    field_path: str
    operator: str = "eq"
    value: Any = None

    def __post_init__(self):
        if self.field_path is None:
            raise TypeError("field_path must not be None")
        if not str(self.field_path).strip():
            raise ValueError("field_path must not be empty")
        if self.operator not in OPERATORS:
            raise ValueError(f"operator '{self.operator}' is not one of {list(OPERATORS)}")


@dataclass(frozen=True)
class QuerySpec:
    """What an analyst asks for: a class, conditions, a look-back window."""

    class_uid: int | None = None
    filters: tuple[FieldFilter, ...] = field(default_factory=tuple)
    time_range_hours: int | None = None
    confidence: float | None = None
    text: str = ""

    def __post_init__(self):
        if self.confidence is not None and not 0.0 <= self.confidence <= 1.0:
            raise ValueError(f"confidence must lie in 0.0-1.0, got {self.confidence}")
        if self.time_range_hours is not None and self.time_range_hours < 1:
            raise ValueError(f"time_range_hours must be at least 1, got {self.time_range_hours}")

    def is_valid(self) -> bool:
        return self.class_uid is not None

    def require_valid(self) -> "QuerySpec":
        if not self.is_valid():
            raise ValueError("the query names no event class")
        return self

    def time_range(self, as_of: datetime | None = None) -> tuple[datetime, datetime] | None:
        if self.time_range_hours is None:
            return None
        end = as_of or datetime.now(timezone.utc)
        return end - timedelta(hours=self.time_range_hours), end


def as_filters(filters) -> list[FieldFilter]:
    """Accept a mapping (equality, null test for None) or FieldFilter items."""
    if not filters:
        return []
    if isinstance(filters, Mapping):
        return [FieldFilter(path, "eq", value) for path, value in filters.items()]
    return list(filters)


def split_known(filters, class_uid: int, registry: FieldRegistry) -> tuple[list[FieldFilter], list[FieldFilter]]:
    """(usable, ignored): a filter on a field the class does not have is ignored."""
    usable, ignored = [], []
    for item in as_filters(filters):
        (usable if registry.is_valid_field(item.field_path, class_uid) else ignored).append(item)
    return usable, ignored


def _typed(value: Any, kind: T.DataType) -> Any:
    """The filter value as the field's type; None when it has no such form."""
    if isinstance(value, bool):
        value = int(value)
    try:
        if isinstance(kind, (T.IntegerType, T.LongType)):
            number = float(value)
            if not math.isfinite(number):
                return None
            return int(value) if not isinstance(value, float) and str(value).strip().lstrip("+-").isdigit() else number
        if isinstance(kind, T.DoubleType):
            return float(value)
        if isinstance(kind, T.TimestampType):
            moment = value if isinstance(value, datetime) else datetime.fromisoformat(str(value))
            return utc(moment)
    except (TypeError, ValueError):
        return None
    return str(value)


def utc(moment: datetime) -> datetime:
    """Naive times are UTC."""
    return moment.replace(tzinfo=timezone.utc) if moment.tzinfo is None else moment.astimezone(timezone.utc)


def compile_filter(item: FieldFilter, registry: FieldRegistry) -> Column:
    column = F.col(item.field_path)
    if item.operator == "is_null" or (item.operator == "eq" and item.value is None):
        return column.isNull()
    if item.operator == "not_null" or (item.operator == "ne" and item.value is None):
        return column.isNotNull()
    if item.value is None:
        return F.lit(False)
    definition = registry.get_field_definition(item.field_path)
    kind = definition.spark_type if definition else T.StringType()
    if item.operator == "contains":
        text = F.array_join(column, " ") if isinstance(kind, T.ArrayType) else column.cast("string")
        return F.contains(F.lower(text), F.lit(str(item.value).lower()))
    if isinstance(kind, T.ArrayType):
        has = F.array_contains(column, str(item.value))
        return {"eq": has, "ne": ~has}.get(item.operator, F.lit(False))
    value = _typed(item.value, kind)
    if value is None:  # no value of the field's type can equal it
        return column.isNotNull() if item.operator == "ne" else F.lit(False)
    literal = F.lit(value)
    return {
        "eq": column == literal,
        "ne": column != literal,
        "gt": column > literal,
        "lt": column < literal,
        "gte": column >= literal,
        "lte": column <= literal,
    }[item.operator]


def time_between(start: datetime, end: datetime) -> Column:
    """Both ends included, whole seconds."""
    low, high = (utc(t).replace(microsecond=0) for t in (start, end))
    return F.col("time").between(F.lit(low), F.lit(high))


def look_back(hours: int, as_of: Column) -> Column:
    if hours < 1:
        raise ValueError(f"hours must be at least 1, got {hours}")
    return (F.col("time") >= as_of - F.make_dt_interval(hours=F.lit(hours))) & (F.col("time") <= as_of)


def all_of(conditions: Iterable[Column]) -> Column | None:
    conditions = list(conditions)
    return reduce(lambda a, b: a & b, conditions) if conditions else None


def filter_events(
    events: DataFrame,
    class_uid: int,
    filters=None,
    time_range: tuple[datetime, datetime] | None = None,
    registry: FieldRegistry | None = None,
) -> DataFrame:
    """Events of one class that meet every condition."""
    registry = registry or FieldRegistry.default()
    registry.check_class(class_uid)
    usable, _ = split_known(filters, class_uid, registry)
    conditions = [F.col("class_uid") == class_uid]
    if time_range is not None:
        conditions.append(time_between(*time_range))
    conditions += [compile_filter(item, registry) for item in usable]
    return events.where(all_of(conditions))
