"""A table of keyed rows in buckets, of which an update rewrites only those that it touches."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.errors import ConcurrentUpdateError
from tidewatch.session import settled
from tidewatch.sources.paths import create_text, newest_text

_BUCKET = "_bucket"
# A table is made with about one bucket for so many rows of its first update, within these bounds.
ROWS_PER_BUCKET = 50_000
MOST_BUCKETS = 256


def hash_bucket(keys: list[str], buckets: int) -> Column:
    """Bucket of a row by a hash of its keys."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("string")


class BucketedTable:
    """Rows with unique ``keys``; ``bucket`` gives each row's bucket as text, from its keys and the table's number of buckets.

    That number is fixed by the first update, unless it is given.

    An update writes new folders for the buckets it touches, then a manifest that says in which version each bucket
    is in force. Manifests are created exclusively: of two writers that started from the same one the slower fails, and a
    job that dies half-way changes nothing. Files of older manifests stay, so readers of one are not disturbed.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: list[str], bucket: Callable[[int], Column], buckets: int | None = None):
        self.spark, self.root, self.schema, self.keys = spark, str(root).rstrip("/"), schema, keys
        self.bucket, self.buckets = bucket, buckets
        self.names = [part.split()[0] for part in schema.split(", ")]

    def manifest(self) -> tuple[dict[str, str], int, int | None]:
        """(version of each bucket, position of the newest manifest, number of buckets)."""
        name, text = newest_text(self.spark, f"{self.root}/current")
        got = json.loads(text) if text else {"buckets": self.buckets, "versions": {}}
        return got["versions"], int(name.split(".")[0]) if name else 0, got["buckets"]

    def _folders(self, versions: dict[str, str]) -> list[str]:
        return [f"{self.root}/versions/{version}/{_BUCKET}={bucket}" for bucket, version in versions.items()]

    def _rows(self, versions: dict[str, str]) -> DataFrame:
        folders = self._folders(versions)
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._rows(self.manifest()[0])

    def read_bucket_of(self, **key) -> DataFrame:
        """The rows of the one bucket that a key can be in."""
        versions, _, buckets = self.manifest()
        if not versions:
            return self._rows({})
        row = self.spark.range(1).select(*[F.lit(value).alias(name) for name, value in key.items()])
        bucket = row.select(self.bucket(buckets).alias("b")).first().b
        return self._rows({b: v for b, v in versions.items() if b == bucket})

    def upsert(self, rows: DataFrame) -> DataFrame:
        """Put rows in the place of those with their keys; returns the new content."""
        versions, position, buckets = self.manifest()
        new = settled(rows.select(*self.names), "bucket-rows")
        if buckets is None:
            buckets = max(1, min(MOST_BUCKETS, new.count() // ROWS_PER_BUCKET))
        new = new.withColumn(_BUCKET, self.bucket(buckets))
        touched = [r[_BUCKET] for r in new.select(_BUCKET).distinct().collect()]  # at most the number of buckets
        if not touched:
            return self._rows(versions)
        old = self._rows({b: versions[b] for b in touched if b in versions}).withColumn(_BUCKET, self.bucket(buckets))
        merged = old.join(new, self.keys, "left_anti").unionByName(new)
        version = uuid.uuid4().hex
        merged.hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.root}/versions/{version}")
        versions = versions | {b: version for b in touched}
        if not create_text(self.spark, f"{self.root}/current/{position + 1:012d}.txt", json.dumps({"buckets": buckets, "versions": versions})):
            raise ConcurrentUpdateError(f"the table below {self.root} was changed meanwhile")
        return self._rows(versions)
