"""How queries and their SQL oracles are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.session import configure
from tidewatch.testbed import derived
from tidewatch.testbed.adapter import FLAT_EVENTS_SQL, FLAT_TO_PATH, REGISTRY

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _class_only(name: str) -> str:
    classes = REGISTRY.get_field_definition(FLAT_TO_PATH[name]).applicable_classes
    return f"CASE WHEN class_uid IN ({', '.join(map(str, classes))}) THEN {name} END AS {name}"


# Names an oracle may read: flat (all columns filled), ev (fields of other classes null) …
_CTES = {
    "flat": FLAT_EVENTS_SQL,
    "ev": "SELECT event_id, class_uid, activity_id, severity_id, event_time, log_source, "
    + ", ".join(_class_only(n) for n in FLAT_TO_PATH)
    + " FROM flat",
    "lines_base": derived.LINES_BASE_DUCKDB,
    "submissions": derived.SUBMISSIONS_SQL,
    "confirmations": derived.CONFIRMATIONS_SQL,
    "query_audit": derived.QUERY_AUDIT_SQL,
    "ingest_audit": derived.INGEST_AUDIT_SQL,
    "indicator_lines": derived.INDICATOR_LINES_SQL,
    "rules": """
        SELECT s.rule_id, s.yaml_content, s.version, s.created_at, c.confirmed_at, c.confirmed_at IS NOT NULL AS confirmed
        FROM (SELECT rule_id, max_by(yaml_content, (submitted_at, o_orderkey)) AS yaml_content,
                CAST(count(*) AS INT) AS version, min(submitted_at) AS created_at FROM submissions GROUP BY rule_id) s
        LEFT JOIN confirmations c ON c.rule_id = s.rule_id AND c.version = s.version""",
    "iocs": """
        SELECT DISTINCT lower(trim(value)) AS ioc FROM indicator_lines
        WHERE trim(value) <> '' AND NOT starts_with(trim(value), '#')""",
}
_USES = {
    "ev": ["flat"],
    "lines_base": ["flat"],
    "confirmations": ["submissions"],
    "rules": ["submissions", "confirmations"],
    "iocs": ["indicator_lines"],
}


def oracle(text: str, *names: str) -> str:
    """SQL with the derived tables it needs in front."""
    order: list[str] = []

    def add(name: str) -> None:
        for used in _USES.get(name, ()):
            add(used)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    if not order:
        return text
    return "WITH " + ",\n".join(f"{n} AS ({_CTES[n]})" for n in order) + "\n" + text


def query(name: str, sql: str | None = None, *uses: str):
    """Register a query; ``sql`` reads the test tables and the derived names in ``uses``."""

    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(configure(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(sql, *uses)
        return build

    return register
