"""Statistics over the audit tables, and paging."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidewatch.operators.rules import rule_counts
from tidewatch.session import scratch_path
from tidewatch.sources.audit import newest
from tidewatch.sources.paths import path_exists

# Class a source format counts for when the audit row names none.
FORMAT_CLASSES = {"zeek": 3001, "apache": 3002, "evtx": 6003, "syslog": 1001}


def _recent(rows: DataFrame, time_column: str, limit: int | None) -> DataFrame:
    return rows if limit is None else newest(rows, time_column, limit)


def system_metrics(
    queries: DataFrame, ingests: DataFrame, rules: DataFrame | None = None, limit: int | None = None
) -> DataFrame:
    """One row of totals over all audit rows, or the newest ``limit`` ones."""
    q = _recent(queries, "executed_at", limit).agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.count_if("success").alias("successful_queries"),
        F.count_if(~F.coalesce("success", F.lit(False))).alias("failed_queries"),
        F.avg(F.when(F.col("success"), F.col("latency_ms"))).alias("avg_query_latency_ms"),
        F.max("executed_at").alias("last_query_at"),
    )
    i = _recent(ingests, "ingested_at", limit).agg(
        F.coalesce(F.sum("event_count"), F.lit(0)).alias("total_ingest_events"),
        F.count(F.lit(1)).alias("total_ingest_runs"),
        F.max("ingested_at").alias("last_ingest_at"),
    )
    totals = _beside(q, i)
    if rules is None:
        return totals.withColumn("rules_stored", F.lit(0)).withColumn("rules_confirmed", F.lit(0))
    return _beside(totals, rule_counts(rules))


def _beside(left: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row result, as a scalar subquery."""
    return left.withColumn("_row", one_row.select(F.struct("*")).scalar()).select(*left.columns, "_row.*")


def success_rate(queries: DataFrame, limit: int | None = None) -> DataFrame:
    succeeded = F.when(F.col("success"), 100.0).otherwise(0.0)
    return _recent(queries, "executed_at", limit).agg(F.coalesce(F.avg(succeeded), F.lit(0.0)).alias("success_rate"))


def format_class(source_format: Column) -> Column:
    found = F.lit(None).cast("int")
    for name, class_uid in FORMAT_CLASSES.items():
        found = F.when(F.lower(source_format) == name, class_uid).otherwise(found)
    return found


def top_event_classes(ingests: DataFrame, k: int = 5, limit: int | None = None) -> DataFrame:
    """Classes with the most ingested events, largest first."""
    if k < 1:
        raise ValueError(f"limit must be at least 1, got {k}")
    rows = _recent(ingests, "ingested_at", limit)
    known = F.col("class_uid") if "class_uid" in rows.columns else F.lit(None).cast("int")
    return (
        rows.select(F.coalesce(known, format_class(F.col("source_format"))).alias("class_uid"), "event_count")
        .where(F.col("class_uid").isNotNull())
        .groupBy("class_uid")
        .agg(F.sum(F.coalesce("event_count", F.lit(0))).alias("event_count"))
        .orderBy(F.col("event_count").desc(), "class_uid")
        .limit(k)
    )


def page_count(rows: DataFrame, page_size: int = 50) -> int:
    if page_size < 1:
        raise ValueError(f"page_size must be at least 1, got {page_size}")
    return max(1, -(-rows.count() // page_size))


def paginate(rows: DataFrame, page: int, page_size: int = 50, order: tuple = ("time",)) -> tuple[DataFrame, int]:
    """(rows of the page, number of pages); pages outside the range are clamped.

    Sort and offset together only keep the leading rows of each partition. For pages far into a
    large result use ``PageIndex``, or ``page_after`` to walk; neither reads skipped rows.
    """
    pages = page_count(rows, page_size)
    page = max(0, min(page, pages - 1))
    return rows.orderBy(*order).offset(page * page_size).limit(page_size), pages


def page_after(rows: DataFrame, last_key: dict, page_size: int = 50) -> DataFrame:
    """The page after ``last_key`` (column -> value of the last row shown), in key order."""
    if page_size < 1:
        raise ValueError(f"page_size must be at least 1, got {page_size}")
    after = F.lit(False)
    for name, value in reversed(list(last_key.items())):
        after = (F.col(name) > F.lit(value)) | ((F.col(name) == F.lit(value)) & after)
    lead = next(iter(last_key))
    pushed = F.col(lead) >= F.lit(last_key[lead])  # plain comparison, reaches the Parquet scan
    return rows.where(pushed & after).orderBy(*last_key).limit(page_size)


class PageIndex:
    """Pages of a large sorted result, of which each opens only the parts of the result that it lies in.

    Rows are written once, range-partitioned and sorted by ``order``; how many rows each part has (a few numbers)
    tells in which part a page begins. ``order`` should end in a column that tells rows apart.
    """

    def __init__(self, rows: DataFrame, order: tuple = ("time",), page_size: int = 50, parts: int | None = None):
        if page_size < 1:
            raise ValueError(f"page_size must be at least 1, got {page_size}")
        self.spark, self.order, self.page_size = rows.sparkSession, order, page_size
        self.path = scratch_path(self.spark, "pages")
        self.schema = rows.schema
        ranged = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
        ranged.withColumn("_part", F.spark_partition_id()).write.partitionBy("_part").parquet(self.path)
        counted = self._stored().groupBy("_part").count().orderBy("_part").collect()  # a row for each part
        self.parts = [r["_part"] for r in counted]
        self.ends = list(accumulate(r["count"] for r in counted))

    def _stored(self) -> DataFrame:
        kind = StructType([*self.schema.fields, StructField("_part", IntegerType())])
        return self.spark.read.schema(kind).parquet(self.path) if path_exists(self.spark, self.path) else self.spark.createDataFrame([], kind)

    @property
    def row_count(self) -> int:
        return self.ends[-1] if self.ends else 0

    @property
    def pages(self) -> int:
        return max(1, -(-self.row_count // self.page_size))

    def parts_of(self, page: int) -> tuple[list[int], int]:
        """The parts that hold a page, and how many rows of the first stand before it."""
        first = max(0, min(page, self.pages - 1)) * self.page_size
        last = min(first + self.page_size, self.row_count)
        low, high = bisect_right(self.ends, first), bisect_left(self.ends, last)
        before = self.ends[low - 1] if low else 0
        return self.parts[low : high + 1], first - before

    def page(self, page: int) -> DataFrame:
        """Rows of a page; pages outside the range are clamped."""
        parts, skipped = self.parts_of(page)
        rows = self._stored().where(F.col("_part").isin(parts)) if parts else self._stored()
        return rows.drop("_part").orderBy(*self.order).offset(skipped).limit(self.page_size)
