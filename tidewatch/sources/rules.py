"""The rule table: append-only submissions and confirmations, with an audit trail."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidewatch.errors import RuleNotConfirmedError, RuleNotFoundError
from tidewatch.operators import rules as ops
from tidewatch.sources.audit import AuditLog
from tidewatch.sources.paths import path_exists

_SUBMISSIONS = "rule_id string, yaml_content string, submitted_at timestamp, sequence bigint"
_ORDER = ("submitted_at", "sequence")
_CONFIRMATIONS = "rule_id string, version int, confirmed_at timestamp"
_EXPORTS = "rule_id string, version int, export_format string, exported_at timestamp"


def _now() -> datetime:
    return datetime.now(timezone.utc)


def _text(value, name: str) -> str:
    if value is None:
        raise TypeError(f"{name} must not be None")
    if not str(value).strip():
        raise ValueError(f"{name} must not be empty")
    return str(value)


class RuleStore:
    """Rule versions are never changed or deleted; the current state is a view over them."""

    def __init__(self, spark: SparkSession, root: str, audit: AuditLog):
        if audit is None:
            raise TypeError("audit must not be None")
        self.spark = spark
        self.root = str(root).rstrip("/")
        self.audit = audit

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/{name}"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def _append(self, name: str, schema: str, *row) -> None:
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")

    # -- views -----------------------------------------------------------
    def submissions(self) -> DataFrame:
        return self._read("submissions", _SUBMISSIONS)

    def versions(self) -> DataFrame:
        return ops.number_versions(self.submissions(), _ORDER)

    def rules(self) -> DataFrame:
        return ops.latest_rules(self.submissions(), self._read("confirmations", _CONFIRMATIONS), _ORDER)

    def list_rules(self, confirmed_only: bool = False) -> DataFrame:
        return ops.list_rules(self.rules(), confirmed_only)

    def exports(self) -> DataFrame:
        return self._read("exports", _EXPORTS)

    def find(self, rule_id: str) -> Row | None:
        if rule_id is None:
            raise TypeError("rule_id must not be None")
        mine = F.col("rule_id") == rule_id
        confirmations = self._read("confirmations", _CONFIRMATIONS).where(mine)
        return ops.latest_rules(self.submissions().where(mine), confirmations, _ORDER).first()

    def get_rule(self, rule_id: str) -> Row:
        row = self.find(rule_id)
        if row is None:
            raise RuleNotFoundError(f"rule '{rule_id}' not found")
        return row

    # -- lifecycle -------------------------------------------------------
    def store_rule(self, rule_id: str, yaml_content: str) -> int:
        """Add a version, unconfirmed; returns its number."""
        rule_id, yaml_content = _text(rule_id, "rule_id"), _text(yaml_content, "yaml_content")
        existing = self.find(rule_id)
        self._append("submissions", _SUBMISSIONS, rule_id, yaml_content, _now(), 0)
        row = self.get_rule(rule_id)
        self.audit.log_rule_event(
            rule_id, "created" if existing is None else "updated", detail=f"sha256={row.sha256}"
        )
        return row.version

    def store_rules(self, submissions: DataFrame) -> None:
        """Add many versions (rule_id, yaml_content) in one job.

        Rows with one time keep the order of the column ``sequence`` if they have it, else
        that in which they are written.
        """
        self_time = F.col("submitted_at") if "submitted_at" in submissions.columns else F.current_timestamp()
        place = F.col("sequence") if "sequence" in submissions.columns else F.monotonically_increasing_id()
        rows = submissions.select("rule_id", "yaml_content", self_time.alias("submitted_at"), place.alias("sequence"))
        rows.write.mode("append").parquet(f"{self.root}/submissions")

    def confirm_rule(self, rule_id: str, session_id: str | None = None) -> None:
        row = self.get_rule(rule_id)
        at = _now()
        self._append("confirmations", _CONFIRMATIONS, rule_id, row.version, at)
        self.audit.log_rule_event(rule_id, "confirmed", session_id, f"confirmed_at={at:%Y-%m-%dT%H:%M:%SZ}")

    def export_rule(self, rule_id: str, format: str = "sigma") -> str:
        row = self.get_rule(rule_id)
        if not row.analyst_confirmed:
            raise RuleNotConfirmedError(f"rule '{rule_id}' is not confirmed")
        self._append("exports", _EXPORTS, rule_id, row.version, format, _now())
        self.audit.log_rule_event(rule_id, "exported", detail=f"format={format}")
        return row.yaml_content
