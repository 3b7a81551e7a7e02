"""A rule against stored and replayed events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.rules import match_rate, match_rule
from tidewatch.sources.rules import RuleStore
from tidewatch.sources.store import EventStore


def with_origin(store: EventStore, session_id: str) -> DataFrame:
    """Stored events of all classes and the session's events, each exactly once."""
    stored = store.scan_all().withColumn("origin", F.lit("base"))
    replayed = store.scan_replay(session_id, must_exist=False)
    if replayed is None:
        return stored
    return stored.unionByName(replayed.drop("session_id").withColumn("origin", F.lit("session")))


def backtest(events: DataFrame, rule_id: str, yaml_content: str, session_id: str, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """(matched events, one-row result). ``events`` has ``origin`` base or session."""
    judged = match_rule(events, yaml_content, compat, skip=("origin",))
    counted = judged.agg(
        F.count_if("matched").alias("match_count"),
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(F.col("origin") == "base").alias("base_events"),
        F.count_if(F.col("origin") == "session").alias("session_events"),
    ).select(
        F.lit(rule_id).alias("rule_id"),
        F.lit(session_id).alias("session_id"),
        "*",
        match_rate(F.col("match_count"), F.col("total_events")).alias("match_rate"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("executed_at"),
    )
    return judged.where("matched").drop("matched"), counted


def backtest_rule(store: EventStore, rules: RuleStore, rule_id: str, session_id: str, compat: bool = False) -> tuple[DataFrame, dict]:
    """Look the rule up, test it, audit it. Returns the matched events (lazy) and the totals."""
    if session_id is None:
        raise TypeError("session_id must not be None")
    rule = rules.get_rule(rule_id)
    matched, counted = backtest(with_origin(store, session_id), rule_id, rule.yaml_content, session_id, compat)
    totals = counted.first().asDict()
    rules.audit.log_rule_event(
        rule_id, "backtested", session_id, f"matched={totals['match_count']}/total={totals['total_events']}"
    )
    return matched, totals
