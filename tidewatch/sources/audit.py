"""Append-only audit tables: queries, ingest runs, rule events."""

from __future__ import annotations

import sys
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources.paths import path_exists

SCHEMAS = {
    "query_audit": "entry_id string, session_id string, sql_template string, event_class int, success boolean, "
    "row_count bigint, latency_ms double, failure_reason string, executed_at timestamp",
    "ingest_audit": "entry_id string, ingest_id string, source_format string, class_uid int, event_count bigint, "
    "failed_count bigint, file_path string, ingested_at timestamp",
    "rule_audit": "entry_id string, rule_id string, event_type string, session_id string, detail string, "
    "occurred_at timestamp",
}
TIME_COLUMN = {"query_audit": "executed_at", "ingest_audit": "ingested_at", "rule_audit": "occurred_at"}


def _now() -> datetime:
    return datetime.now(timezone.utc)


class AuditLog:
    """Entries are small; callers with many at once append a DataFrame instead."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = str(root).rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def append(self, table: str, rows: DataFrame) -> None:
        rows.select(*self.empty(table).columns).write.mode("append").parquet(self.path(table))

    def empty(self, table: str) -> DataFrame:
        return self.spark.createDataFrame([], SCHEMAS[table])

    def read(self, table: str) -> DataFrame:
        if not path_exists(self.spark, self.path(table)):
            return self.empty(table)
        return self.spark.read.schema(SCHEMAS[table]).parquet(self.path(table))

    def _one(self, table: str, *values) -> None:
        row = self.spark.createDataFrame([(uuid.uuid4().hex, *values)], SCHEMAS[table])
        self.append(table, row.coalesce(1))

    def log_query(
        self,
        session_id: str,
        sql_template: str,
        event_class: int | None = None,
        success: bool = True,
        row_count: int | None = None,
        latency_ms: float | None = None,
        failure_reason: str | None = None,
        executed_at: datetime | None = None,
    ) -> None:
        """Never raises: a failed audit write must not fail the analyst's query."""
        try:
            self._one(
                "query_audit", session_id, sql_template, event_class, success,
                row_count, latency_ms, failure_reason, executed_at or _now(),
            )
        except Exception as err:  # storage trouble comes in many classes
            print(f"query audit not written: {str(err)[:300]}", file=sys.stderr)

    def log_ingest(
        self,
        ingest_id: str,
        source_format: str,
        event_count: int = 0,
        failed_count: int = 0,
        file_path: str | None = None,
        class_uid: int | None = None,
        ingested_at: datetime | None = None,
    ) -> None:
        self._one(
            "ingest_audit", ingest_id, source_format, class_uid, event_count,
            failed_count, file_path, ingested_at or _now(),
        )

    def log_rule_event(
        self,
        rule_id: str,
        event_type: str,
        session_id: str | None = None,
        detail: str | None = None,
        occurred_at: datetime | None = None,
    ) -> None:
        self._one("rule_audit", rule_id, event_type, session_id, detail, occurred_at or _now())

    # -- history ---------------------------------------------------------
    def query_history(self, session_id: str | None = None, limit: int = 100) -> DataFrame:
        rows = self.read("query_audit")
        if session_id is not None:
            rows = rows.where(F.col("session_id") == session_id)
        return newest(rows, "executed_at", limit)

    def ingest_history(self, limit: int = 50) -> DataFrame:
        return newest(self.read("ingest_audit"), "ingested_at", limit)


def newest(rows: DataFrame, time_column: str, limit: int) -> DataFrame:
    """The latest rows first; ties are broken by entry id where there is one."""
    if limit < 1:
        raise ValueError(f"limit must be at least 1, got {limit}")
    order = [F.col(time_column).desc()]
    if "entry_id" in rows.columns:
        order.append(F.col("entry_id").desc())
    return rows.orderBy(*order).limit(limit)
