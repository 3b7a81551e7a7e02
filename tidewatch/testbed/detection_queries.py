"""Queries on indicators, rules, backtests, coverage and audit statistics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidewatch.operators import coverage, indicators, intents, rules, system
from tidewatch.plans import backtest as backtest_plan
from tidewatch.session import scratch_path
from tidewatch.sources import indicators as indicator_source
from tidewatch.sources.audit import newest
from tidewatch.sources.store import EventStore
from tidewatch.testbed import derived
from tidewatch.testbed.adapter import REGISTRY, security_events
from tidewatch.testbed.catalog import query
from tidewatch.testbed.derived import as_text_time

# -- indicators -------------------------------------------------------------------


def _iocs(spark, sf):
    return indicator_source.distinct_indicators(indicator_source.indicator_rows(derived.indicator_lines(spark, sf)))


_HITS = """
    SELECT event_id, concat_ws('|',
      CASE WHEN lower(src_ip) IN (SELECT ioc FROM iocs) THEN src_ip END,
      CASE WHEN lower(dst_ip) IN (SELECT ioc FROM iocs) THEN dst_ip END,
      CASE WHEN lower(file_path) IN (SELECT ioc FROM iocs) THEN file_path END,
      CASE WHEN lower(user_name) IN (SELECT ioc FROM iocs) THEN user_name END) AS matches, class_uid FROM ev
"""


@query("ioc_hits", f"SELECT event_id, matches FROM ({_HITS}) h WHERE matches <> ''", "ev", "iocs")
def ioc_hits(spark, sf):
    found = indicators.indicator_hits(security_events(spark, sf), _iocs(spark, sf))
    return found.select("event_id", F.array_join("ioc_matches", "|").alias("matches"))


@query("ioc_clean", f"SELECT event_id, class_uid FROM ({_HITS}) h WHERE matches = ''", "ev", "iocs")
def ioc_clean(spark, sf):
    return indicators.clean_events(security_events(spark, sf), _iocs(spark, sf)).select("event_id", "class_uid")


@query("ioc_hits_shuffled", f"SELECT event_id, matches FROM ({_HITS}) h WHERE matches <> ''", "ev", "iocs")
def ioc_hits_shuffled(spark, sf):
    """The path for lists too large to broadcast."""
    found = indicators.indicator_hits(security_events(spark, sf), _iocs(spark, sf), max_bytes=0)
    return found.select("event_id", F.array_join("ioc_matches", "|").alias("matches"))


@query(
    "ioc_loaded",
    "SELECT file_path, count(*) AS loaded FROM indicator_lines WHERE trim(value) <> '' "
    "AND NOT starts_with(trim(value), '#') GROUP BY file_path",
    "indicator_lines",
)
def ioc_loaded(spark, sf):
    return indicator_source.loaded_per_file(indicator_source.indicator_rows(derived.indicator_lines(spark, sf)))


@query(
    "ioc_cap_per_file",
    """
    SELECT file_path, ioc FROM (
      SELECT file_path, lower(trim(value)) AS ioc, row_number() OVER (PARTITION BY file_path ORDER BY seq) AS rank
      FROM indicator_lines WHERE trim(value) <> '' AND NOT starts_with(trim(value), '#')) r WHERE rank <= 100
    """,
    "indicator_lines",
)
def ioc_cap_per_file(spark, sf):
    return indicator_source.indicator_rows(derived.indicator_lines(spark, sf), cap=100)


@query("ioc_count", "SELECT count(*) AS ioc_count FROM iocs", "iocs")
def ioc_count(spark, sf):
    return indicator_source.count_indicators(indicator_source.indicator_rows(derived.indicator_lines(spark, sf)))


# -- rules ---------------------------------------------------------------------------


def _rules(spark, sf):
    return rules.latest_rules(
        derived.submissions(spark, sf), derived.confirmations(spark, sf), order=("submitted_at", "o_orderkey")
    )


@query(
    "rules_latest",
    "SELECT rule_id, sha256(yaml_content) AS sha256, version, confirmed AS analyst_confirmed, "
    "strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM rules",
    "rules",
)
def rules_latest(spark, sf):
    return _rules(spark, sf).select(
        "rule_id", "sha256", "version", "analyst_confirmed", as_text_time("created_at").alias("created_at")
    )


@query(
    "rule_versions",
    "SELECT rule_id, o_orderkey, CAST(row_number() OVER (PARTITION BY rule_id ORDER BY submitted_at, o_orderkey) AS INT) AS version "
    "FROM submissions",
    "submissions",
)
def rule_versions(spark, sf):
    numbered = rules.number_versions(derived.submissions(spark, sf), order=("submitted_at", "o_orderkey"))
    return numbered.select("rule_id", "o_orderkey", "version")


@query("rules_confirmed", "SELECT rule_id, version FROM rules WHERE confirmed", "rules")
def rules_confirmed(spark, sf):
    return rules.list_rules(_rules(spark, sf), confirmed_only=True).select("rule_id", "version")


@query(
    "rules_export",
    "SELECT rule_id, version, CASE WHEN confirmed THEN sha256(yaml_content) END AS exported_sha256, NOT confirmed AS refused FROM rules",
    "rules",
)
def rules_export(spark, sf):
    """What an export of every rule gives: the text, or a refusal where the latest version is not confirmed."""
    return rules.exports(_rules(spark, sf)).select("rule_id", "version", F.sha2("exported", 256).alias("exported_sha256"), "refused")


@query(
    "rule_counts",
    "SELECT count(*) AS rules_stored, count(*) FILTER (confirmed) AS rules_confirmed FROM rules",
    "rules",
)
def rule_counts(spark, sf):
    return rules.rule_counts(_rules(spark, sf))


@query(
    "rule_keywords",
    """
    SELECT rule_id, 'user' || regexp_extract(yaml_content, 'User([0-9]+)', 1) AS keyword FROM rules
    UNION SELECT rule_id, regexp_extract(yaml_content, '"(10[.0-9]+)"', 1) FROM rules
    """,
    "rules",
)
def rule_keywords(spark, sf):
    return rules.rule_keywords(_rules(spark, sf))


@query(
    "rule_keywords_compat",
    """
    SELECT rule_id, 'user' || regexp_extract(yaml_content, 'User([0-9]+)', 1) AS keyword FROM rules
    UNION SELECT rule_id, '- user' || regexp_extract(yaml_content, 'User([0-9]+)', 1) FROM rules
    UNION SELECT rule_id, regexp_extract(yaml_content, '"(10[.0-9]+)"', 1) FROM rules
    UNION SELECT rule_id, lower('attack.' || regexp_extract(yaml_content, 'attack[.](T[0-9.]+)', 1)) FROM rules
    UNION SELECT rule_id, 'none' FROM rules
    """,
    "rules",
)
def rule_keywords_compat(spark, sf):
    return rules.rule_keywords(_rules(spark, sf), compat=True)


# Text of an event as the backtest sees it, in schema order.
_EVENT_TEXT = """
    lower(concat_ws(' ', class_uid, activity_id, severity_id, strftime(event_time, '%Y-%m-%dT%H:%M:%S'), log_source,
      strftime(event_time, '%Y-%m-%d %H:%M:%S'), src_ip, src_hostname, dst_ip, dst_port, bytes_out, url_path, http_code,
      user_name, actor_process, child_process, file_path, auth_protocol))
"""


@query(
    "backtest_counts",
    f"""
    , texts AS (SELECT {_EVENT_TEXT} AS text FROM ev),
    words AS (SELECT rule_id, 'user' || regexp_extract(yaml_content, 'User([0-9]+)', 1) AS a,
      regexp_extract(yaml_content, '"(10[.0-9]+)"', 1) AS b FROM rules),
    pairs AS (SELECT a, b, count(*) AS n FROM (SELECT DISTINCT a, b FROM words) w, texts
      WHERE contains(text, a) OR contains(text, b) GROUP BY a, b)
    SELECT w.rule_id, coalesce(p.n, 0) AS match_count, (SELECT count(*) FROM ev) AS total_events
    FROM words w LEFT JOIN pairs p ON p.a = w.a AND p.b = w.b
    """,
    "rules",
    "ev",
)
def backtest_counts(spark, sf):
    return rules.backtest_rules(security_events(spark, sf), _rules(spark, sf), skip=("event_id",))


_RULE_YAML = "title: shadow\ndetection:\n  keywords:\n    - /ETC/shadow\n    - 'schtasks'\nfalsepositives:\n  - user1\n"


@query(
    "backtest_matches",
    f"SELECT event_id, class_uid FROM ev WHERE contains({_EVENT_TEXT}, '/etc/shadow') OR contains({_EVENT_TEXT}, 'schtasks')",
    "ev",
)
def backtest_matches(spark, sf):
    judged = rules.match_rule(security_events(spark, sf), _RULE_YAML, skip=("event_id",))
    return judged.where("matched").select("event_id", "class_uid")


@query(
    "backtest_session",
    f"""
    SELECT count(*) FILTER (hit) AS match_count, count(*) AS total_events,
      count(*) FILTER (event_time < TIMESTAMP '2024-01-21') AS base_events,
      count(*) FILTER (event_time >= TIMESTAMP '2024-01-21') AS session_events,
      printf('%.1f%%', count(*) FILTER (hit) * 100.0 / count(*)) AS match_rate
    FROM (SELECT event_time, contains({_EVENT_TEXT}, '/etc/shadow') OR contains({_EVENT_TEXT}, 'schtasks') AS hit FROM ev) e
    """,
    "ev",
)
def backtest_session(spark, sf):
    store = EventStore(spark, scratch_path(spark, "backtest"), REGISTRY)
    rows = security_events(spark, sf)
    cut = F.lit("2024-01-21").cast("timestamp")
    store.append(rows.where(F.col("time") < cut), "testbed", run_id="base")
    store.append_replay(rows.where(F.col("time") >= cut), "session-1", run_id="replay")
    _, totals = backtest_plan.backtest(backtest_plan.with_origin(store, "session-1"), "r1", _RULE_YAML, "session-1")
    return totals.select("match_count", "total_events", "base_events", "session_events", "match_rate")


# -- coverage -------------------------------------------------------------------------

_CLASS_UIDS = {
    "T1078": "6003", "T1078.002": "6003", "T1110": "6003", "T1110.001": "6003",
    "T1059": "4001", "T1059.001": "4001", "T1055": "4001", "T1053": "4001",
    "T1071": "3001", "T1048": "3001", "T1090": "3001", "T1046": "3001",
    "T1190": "3002", "T1059.007": "3002", "T1005": "1001", "T1070.004": "1001",
}
_MATRIX = "(" + " UNION ALL ".join(
    f"SELECT '{t}' AS technique_id, '{tactic}' AS tactic, {coverage.TACTICS.index(tactic)} AS tactic_order, "
    f"EXISTS (SELECT 1 FROM rules WHERE confirmed AND contains(yaml_content, '{t}')) AS has_sigma_rule, "
    f"'{_CLASS_UIDS[t]}' AS class_uids"
    for t, tactic in coverage.TECHNIQUE_TACTICS.items()
) + ") m"


def _matrix(spark, sf):
    return coverage.coverage_matrix(_rules(spark, sf))


@query(
    "coverage_matrix",
    f"SELECT technique_id, tactic, true AS has_rule_match, has_sigma_rule, class_uids FROM {_MATRIX}",
    "rules",
)
def coverage_matrix(spark, sf):
    return _matrix(spark, sf).withColumn("class_uids", F.array_join(F.col("class_uids").cast("array<string>"), ","))


_SUMMARY = f"""
    SELECT count(*) AS total_techniques, count(*) AS rule_match_count, count(*) FILTER (has_sigma_rule) AS sigma_confirmed_count,
      count(*) FILTER (has_sigma_rule) * 100.0 / count(*) AS coverage_percent,
      coalesce(list(technique_id ORDER BY tactic_order, technique_id) FILTER (NOT has_sigma_rule), []) AS uncovered
    FROM {_MATRIX}
"""


@query(
    "coverage_summary",
    "SELECT total_techniques, rule_match_count, sigma_confirmed_count, CAST(coverage_percent AS DOUBLE) AS coverage_percent, "
    f"array_to_string(uncovered, ',') AS uncovered_techniques FROM ({_SUMMARY}) s",
    "rules",
)
def coverage_summary(spark, sf):
    summary = coverage.coverage_summary(_matrix(spark, sf))
    return summary.withColumn("uncovered_techniques", F.array_join("uncovered_techniques", ",")).withColumn(
        "coverage_percent", F.col("coverage_percent").cast("double")
    )


@query(
    "coverage_text",
    f"""
    SELECT 'ATT&CK Coverage: ' || sigma_confirmed_count || '/' || total_techniques || ' techniques (' ||
      printf('%.1f', CAST(coverage_percent AS DOUBLE)) || '%)' || chr(10) || 'Uncovered techniques: ' || len(uncovered) ||
      CASE WHEN len(uncovered) > 0 THEN chr(10) || 'Missing: ' || array_to_string(uncovered[1:10], ', ') ELSE '' END AS text
    FROM ({_SUMMARY}) s
    """,
    "rules",
)
def coverage_text(spark, sf):
    return coverage.coverage_text(coverage.coverage_summary(_matrix(spark, sf)))


@query(
    "coverage_by_tactic",
    f"SELECT tactic, count(*) AS techniques, count(*) FILTER (has_sigma_rule) AS covered FROM {_MATRIX} GROUP BY tactic",
    "rules",
)
def coverage_by_tactic(spark, sf):
    return coverage.coverage_by_tactic(_matrix(spark, sf))


@query(
    "coverage_for_tactic",
    f"SELECT technique_id, has_sigma_rule FROM {_MATRIX} WHERE tactic = 'Defense Evasion'",
    "rules",
)
def coverage_for_tactic(spark, sf):
    return coverage.techniques_for_tactic(_matrix(spark, sf), "Defense Evasion").select("technique_id", "has_sigma_rule")


@query("coverage_uncovered", f"SELECT technique_id FROM {_MATRIX} WHERE NOT has_sigma_rule", "rules")
def coverage_uncovered(spark, sf):
    return coverage.uncovered_techniques(_matrix(spark, sf)).select("technique_id")


@query(
    "heatmap_pivot",
    "SELECT tactic, "
    + ", ".join(
        f"coalesce(max(CASE WHEN technique_id = '{t}' THEN CASE WHEN has_sigma_rule THEN 'sigma' ELSE 'rule' END END), 'none') "
        f'AS "{t.replace(".", "_")}"'
        for t in coverage.TECHNIQUE_TACTICS
    )
    + f" FROM {_MATRIX} GROUP BY tactic",
    "rules",
)
def heatmap_pivot(spark, sf):
    grid = coverage.heatmap(_matrix(spark, sf))
    return grid.toDF(*[c.replace(".", "_") for c in grid.columns])


# -- audit statistics ---------------------------------------------------------------------

_SYSTEM = """
    SELECT q.*, i.*, r.* FROM
      (SELECT count(*) AS total_queries, count(*) FILTER (success) AS successful_queries,
        count(*) FILTER (NOT success) AS failed_queries,
        round(avg(latency_ms) FILTER (success), 3) AS avg_query_latency_ms,
        strftime(max(executed_at), '%Y-%m-%d %H:%M:%S') AS last_query_at FROM {queries}) q,
      (SELECT CAST(sum(event_count) AS BIGINT) AS total_ingest_events, count(*) AS total_ingest_runs,
        strftime(max(ingested_at), '%Y-%m-%d %H:%M:%S') AS last_ingest_at FROM {ingests}) i,
      (SELECT count(*) AS rules_stored, count(*) FILTER (confirmed) AS rules_confirmed FROM rules) r
"""


def _system(spark, sf, limit):
    totals = system.system_metrics(
        derived.query_audit(spark, sf), derived.ingest_audit(spark, sf), _rules(spark, sf), limit
    )
    return (
        totals.withColumn("avg_query_latency_ms", F.round("avg_query_latency_ms", 3))
        .withColumn("last_query_at", as_text_time("last_query_at"))
        .withColumn("last_ingest_at", as_text_time("last_ingest_at"))
    )


@query(
    "system_metrics",
    _SYSTEM.format(queries="query_audit", ingests="ingest_audit"),
    "query_audit",
    "ingest_audit",
    "rules",
)
def system_metrics(spark, sf):
    return _system(spark, sf, None)


@query(
    "system_metrics_recent",
    _SYSTEM.format(
        queries="(SELECT * FROM query_audit ORDER BY executed_at DESC, entry_id DESC LIMIT 10000) x",
        ingests="(SELECT * FROM ingest_audit ORDER BY ingested_at DESC, entry_id DESC LIMIT 10000) y",
    ),
    "query_audit",
    "ingest_audit",
    "rules",
)
def system_metrics_recent(spark, sf):
    """The same restricted to the newest rows, here 10,000 of each kind."""
    return _system(spark, sf, 10_000)


@query(
    "success_rate",
    "SELECT round(count(*) FILTER (success) * 100.0 / count(*), 6) AS success_rate FROM query_audit",
    "query_audit",
)
def success_rate(spark, sf):
    return system.success_rate(derived.query_audit(spark, sf), None).select(F.round("success_rate", 6).alias("success_rate"))


@query(
    "top_classes",
    """
    SELECT class_uid, CAST(sum(event_count) AS BIGINT) AS event_count FROM (
      SELECT CAST(CASE lower(source_format) WHEN 'zeek' THEN 3001 WHEN 'apache' THEN 3002 WHEN 'evtx' THEN 6003
        WHEN 'syslog' THEN 1001 END AS INT) AS class_uid, event_count FROM ingest_audit) c
    WHERE class_uid IS NOT NULL GROUP BY class_uid ORDER BY event_count DESC, class_uid LIMIT 3
    """,
    "ingest_audit",
)
def top_classes(spark, sf):
    return system.top_event_classes(derived.ingest_audit(spark, sf), k=3, limit=None)


@query(
    "query_history",
    "SELECT entry_id, session_id, strftime(executed_at, '%Y-%m-%d %H:%M:%S') AS executed_at FROM query_audit "
    "ORDER BY executed_at DESC, entry_id DESC LIMIT 100",
    "query_audit",
)
def query_history(spark, sf):
    recent = newest(derived.query_audit(spark, sf), "executed_at", 100)
    return recent.select("entry_id", "session_id", as_text_time("executed_at").alias("executed_at"))


@query(
    "ingest_history",
    "SELECT entry_id, source_format, event_count FROM ingest_audit ORDER BY ingested_at DESC, entry_id DESC LIMIT 50",
    "ingest_audit",
)
def ingest_history(spark, sf):
    return newest(derived.ingest_audit(spark, sf), "ingested_at", 50).select("entry_id", "source_format", "event_count")


@query(
    "page_2",
    "SELECT event_id, (SELECT CAST(ceil(count(*) / 50.0) AS BIGINT) FROM ev) AS total_pages FROM ev "
    "ORDER BY event_time, event_id LIMIT 50 OFFSET 100",
    "ev",
)
def page_2(spark, sf):
    page, pages = system.paginate(security_events(spark, sf), 2, 50, order=("time", "event_id"))
    return page.select("event_id", F.lit(pages).cast("bigint").alias("total_pages"))


@query(
    "page_deep",
    "SELECT event_id, (SELECT CAST(ceil(count(*) / 50.0) AS BIGINT) FROM ev) AS total_pages FROM ev "
    "ORDER BY event_time, event_id LIMIT 50 OFFSET (SELECT CAST(ceil(count(*) / 50.0) AS BIGINT) * 50 - 150 FROM ev)",
    "ev",
)
def page_deep(spark, sf):
    """The last page but two, out of the one part of the sorted result that holds it."""
    index = system.PageIndex(security_events(spark, sf), order=("time", "event_id"), parts=8)
    return index.page(index.pages - 3).select("event_id", F.lit(index.pages).cast("bigint").alias("total_pages"))


@query(
    "page_after",
    "SELECT event_id FROM ev WHERE event_time >= TIMESTAMP '2024-01-15' ORDER BY event_time, event_id LIMIT 50",
    "ev",
)
def page_after(spark, sf):
    at = datetime(2024, 1, 15)
    rows = security_events(spark, sf)
    return system.page_after(rows, {"time": F.lit(at.isoformat()).cast("timestamp"), "event_id": -1}).select("event_id")


# -- decoded intents ------------------------------------------------------------------------


@query(
    "intent_decode",
    """
    SELECT event_id,
      CAST(CASE WHEN event_id % 7 = 0 OR event_id % 5 = 0 THEN NULL ELSE class_uid END AS INT) AS class_uid,
      CASE WHEN event_id % 7 = 0 THEN '' ELSE 'src_endpoint.ip eq ' || src_ip END AS filters,
      CAST(CASE WHEN event_id % 7 = 0 OR event_id % 4 = 0 THEN NULL ELSE event_id % 4 END AS INT) AS time_range_hours,
      CASE WHEN event_id % 7 = 0 THEN 0.0::DOUBLE WHEN event_id % 3 = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS confidence
    FROM flat
    """,
    "flat",
)
def intent_decode(spark, sf):
    responses = derived.sql(spark, sf, derived.INTENT_SQL, "flat")
    decoded = intents.decode_intents(responses)
    texts = F.transform("intent.filters", lambda f: F.concat_ws(" ", f["field_path"], f["operator"], f["value"]))
    return decoded.select(
        "event_id",
        "intent.class_uid",
        F.array_join(texts, ";").alias("filters"),
        "intent.time_range_hours",
        "intent.confidence",
    )


@query(
    "intent_valid",
    """
    SELECT event_id, CAST(class_uid AS INT) AS class_uid, 'src_endpoint.ip eq ' || src_ip AS filters
    FROM flat WHERE event_id % 7 <> 0 AND event_id % 5 <> 0
    """,
    "flat",
)
def intent_valid(spark, sf):
    """Decoded queries that pass the gate: those that name a class."""
    valid = intents.runnable_intents(intents.decode_intents(derived.sql(spark, sf, derived.INTENT_SQL, "flat")))
    filters = F.array_join(F.transform("intent.filters", lambda f: F.concat_ws(" ", f["field_path"], f["operator"], f["value"])), ";")
    return valid.select("event_id", "intent.class_uid", filters.alias("filters"))
