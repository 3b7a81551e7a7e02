"""Stored baselines and the daily moments they can be put together from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.baselines import KEYS
from tidewatch.operators.moments import merged
from tidewatch.sources.bucketed import BucketedTable, hash_bucket

SCHEMA = (
    "entity_type string, entity_value string, metric_name string, class_uid int, mean double, stddev double, "
    "observation_count bigint, window_start string, window_end string, computed_at string"
)
MOMENTS_SCHEMA = (
    "entity_type string, entity_value string, metric_name string, class_uid int, day date, n bigint, mean double, m2 double, "
    "first_time timestamp, last_time timestamp"
)


class BaselineStore:
    """One row per key, in buckets by key; an upsert leaves the files of other buckets alone."""

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        self.table = BucketedTable(spark, root, SCHEMA, KEYS, lambda n: hash_bucket(KEYS, n), buckets)

    def read(self) -> DataFrame:
        return self.table.read()

    def upsert(self, computed: DataFrame) -> DataFrame:
        """Replace the recomputed keys, keep the others; returns the new content."""
        return self.table.upsert(computed)

    def get_baseline(self, entity_type: str, entity_value: str, metric_name: str, class_uid: int):
        key = {"entity_type": entity_type, "entity_value": entity_value, "metric_name": metric_name, "class_uid": class_uid}
        for name, value in key.items():
            if value is None:
                raise TypeError(f"{name} must not be None")
        found = self.table.read_bucket_of(**key)
        for name, value in key.items():
            found = found.where(F.col(name) == value)
        return found.first()


def day_bucket(buckets: int) -> Column:
    return F.concat_ws("-", F.date_format("day", "yyyyMMdd"), hash_bucket(KEYS, buckets))


class MomentStore:
    """Moments of each entity and day, in buckets by day and key: a day's update rewrites that day only.

    A day that is computed again replaces the day, so repeated runs count nothing twice.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        self.table = BucketedTable(spark, root, MOMENTS_SCHEMA, [*KEYS, "day"], day_bucket, buckets)

    def read(self) -> DataFrame:
        return self.table.read()

    def put_days(self, moments: DataFrame) -> DataFrame:
        """Store the moments of whole days; returns all."""
        return self.table.upsert(moments)

    def baselines(self, **options) -> DataFrame:
        """Baselines over all stored days, without a look at any event."""
        return merged(self.read(), **options)


SKETCHES_SCHEMA = "entity_type string, entity_value string, metric_name string, class_uid int, day date, sketch binary"


class SketchStore:
    """Distinct-count sketches of each entity and day, kept like moments: a day's update rewrites that day only."""

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        self.table = BucketedTable(spark, root, SKETCHES_SCHEMA, [*KEYS, "day"], day_bucket, buckets)

    def read(self) -> DataFrame:
        return self.table.read()

    def put_days(self, sketches: DataFrame) -> DataFrame:
        """Store the sketches of whole days; returns all."""
        return self.table.upsert(sketches)
