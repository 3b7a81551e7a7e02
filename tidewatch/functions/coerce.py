"""Coercion of dirty text to the registry's types. No expression here can fail a job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Seconds from year 1 to year 9999, the range calendars accept.
_MIN_EPOCH = -62135596800
_MAX_EPOCH = 253402300799


def epoch_to_time(c: Column) -> Column:
    seconds = c.try_cast("double")
    usable = seconds.between(_MIN_EPOCH, _MAX_EPOCH)  # false for NaN and infinities
    return F.when(usable, F.timestamp_micros(F.round(seconds * 1e6).cast("bigint")))


def iso_to_time(c: Column) -> Column:
    text = c.cast("string")
    full = F.when(text.rlike(r"^\s*\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text))
    basic = F.when(text.rlike(r"^\d{8}T\d{6}"), F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmss[X]")))
    return F.coalesce(full, basic)


def parse_time(c: Column, formats: tuple[str, ...] = ()) -> Column:
    """Epoch seconds, then ISO 8601, then the extra formats; null when none fits."""
    attempts = [epoch_to_time(c), iso_to_time(c)]
    attempts += [F.try_to_timestamp(c.cast("string"), F.lit(fmt)) for fmt in formats]
    return F.coalesce(*attempts)


def parse_int(c: Column) -> Column:
    return c.cast("string").try_cast("int")


def to_registry_type(c: Column, kind: T.DataType, formats: tuple[str, ...] = ()) -> Column:
    if isinstance(kind, T.TimestampType):
        return parse_time(c, formats)
    if isinstance(kind, T.ArrayType):
        return F.split(c.cast("string"), ",")
    if isinstance(kind, T.StringType):
        return c.cast("string")
    return c.cast("string").try_cast(kind)
