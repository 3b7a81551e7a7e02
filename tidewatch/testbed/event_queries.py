"""Queries on events: filters, scans, tagging, metrics, baselines, anomalies, timelines."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidewatch.operators import anomalies, baselines, events as event_ops, filters, metrics, moments, normalize, sketches, techniques, timeline
from tidewatch.operators.filters import FieldFilter
from tidewatch.plans import behaviour
from tidewatch.registry import MetricDefinition, MetricRegistry
from tidewatch.session import scratch_path, settled
from tidewatch.sources.baselines import BaselineStore, MomentStore, SketchStore
from tidewatch.sources.store import EventStore
from tidewatch.testbed.adapter import REGISTRY, flat_events, nest, security_events
from tidewatch.testbed.catalog import oracle, query
from tidewatch.testbed.derived import TIME_TEXT_SQL, as_text_time, lines

METRICS = MetricRegistry.default()
BYTES_OUT = METRICS.require("net_bytes_out_per_hour", 3001)
PROCESS_COUNT = METRICS.require("process_exec_count", 4001)

# -- scans and filters ---------------------------------------------------------


@query(
    "event_filter_conj",
    "SELECT event_id, src_ip, dst_port, bytes_out FROM ev "
    "WHERE class_uid = 3001 AND dst_port = 443 AND src_ip = '10.0.0.7' AND bytes_out > 100000",
    "ev",
)
def event_filter_conj(spark, sf):
    conditions = [
        FieldFilter("dst_endpoint.port", "eq", 443),
        FieldFilter("src_endpoint.ip", "eq", "10.0.0.7"),
        FieldFilter("network.bytes_out", "gt", 100000),
        FieldFilter("file.path", "eq", "ignored: not a field of this class"),
    ]
    return filters.filter_events(security_events(spark, sf), 3001, conditions, registry=REGISTRY).select(
        "event_id",
        F.col("src_endpoint.ip").alias("src_ip"),
        F.col("dst_endpoint.port").alias("dst_port"),
        F.col("network.bytes_out").alias("bytes_out"),
    )


_OPERATOR_CASES = {
    "eq": FieldFilter("src_endpoint.ip", "eq", "10.0.0.5"),
    "ne": FieldFilter("dst_endpoint.port", "ne", 80),
    "gt": FieldFilter("network.bytes_out", "gt", 5000000),
    "lt": FieldFilter("network.bytes_out", "lt", 5000000),
    "gte": FieldFilter("dst_endpoint.port", "gte", 443),
    "lte": FieldFilter("dst_endpoint.port", "lte", "443"),
    "contains": FieldFilter("src_endpoint.hostname", "contains", "HOST1"),
    "is_null": FieldFilter("dst_endpoint.port", "is_null"),
    "not_null": FieldFilter("dst_endpoint.port", "not_null"),
}


@query(
    "event_filter_ops",
    """
    SELECT 'eq' AS operator, count(*) FILTER (src_ip = '10.0.0.5') AS events FROM ev WHERE class_uid = 3001
    UNION ALL SELECT 'ne', count(*) FILTER (dst_port <> 80) FROM ev WHERE class_uid = 3001
    UNION ALL SELECT 'gt', count(*) FILTER (bytes_out > 5000000) FROM ev WHERE class_uid = 3001
    UNION ALL SELECT 'lt', count(*) FILTER (bytes_out < 5000000) FROM ev WHERE class_uid = 3001
    UNION ALL SELECT 'gte', count(*) FILTER (dst_port >= 443) FROM ev WHERE class_uid = 3001
    UNION ALL SELECT 'lte', count(*) FILTER (dst_port <= 443) FROM ev WHERE class_uid = 3001
    UNION ALL SELECT 'contains', count(*) FILTER (contains(lower(src_hostname), 'host1')) FROM ev WHERE class_uid = 3001
    UNION ALL SELECT 'is_null', count(*) FILTER (dst_port IS NULL) FROM ev WHERE class_uid = 3001
    UNION ALL SELECT 'not_null', count(*) FILTER (dst_port IS NOT NULL) FROM ev WHERE class_uid = 3001
    """,
    "ev",
)
def event_filter_ops(spark, sf):
    network = security_events(spark, sf).where("class_uid = 3001")
    counted = network.agg(
        *[F.count_if(filters.compile_filter(c, REGISTRY)).alias(name) for name, c in _OPERATOR_CASES.items()]
    )
    return counted.unpivot([], list(_OPERATOR_CASES), "operator", "events")


@query(
    "event_time_range",
    "SELECT event_id, strftime(event_time, '%Y-%m-%d %H:%M:%S') AS time, user_name FROM ev WHERE class_uid = 6003 "
    "AND event_time BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-10 18:30:00'",
    "ev",
)
def event_time_range(spark, sf):
    window = (datetime(2024, 1, 5, 6), datetime(2024, 1, 10, 18, 30))
    return filters.filter_events(security_events(spark, sf), 6003, None, window, REGISTRY).select(
        "event_id", as_text_time("time").alias("time"), F.col("actor.user.name").alias("user_name")
    )


@query(
    "event_look_back",
    "SELECT event_id, class_uid FROM ev WHERE event_time >= (SELECT max(event_time) FROM ev) - INTERVAL 48 HOUR",
    "ev",
)
def event_look_back(spark, sf):
    rows = security_events(spark, sf)
    newest = rows.agg(F.max("time").alias("t")).scalar()
    return rows.where(filters.look_back(48, newest)).select("event_id", "class_uid")


@query(
    "class_scan_limit",
    "SELECT event_id, bytes_out FROM ev WHERE class_uid = 3001 AND bytes_out > 1000000 ORDER BY event_id LIMIT 25",
    "ev",
)
def class_scan_limit(spark, sf):
    rows = security_events(spark, sf).where("class_uid = 3001").where(F.expr("network.bytes_out > 1000000"))
    return rows.orderBy("event_id").limit(25).select("event_id", F.col("network.bytes_out").alias("bytes_out"))


@query("class_partitions", "SELECT DISTINCT class_uid FROM ev", "ev")
def class_partitions(spark, sf):
    return security_events(spark, sf).select("class_uid").distinct().orderBy("class_uid")


def _store(spark, sf, label: str):
    """A store with the first twenty days as base events and the rest as a replay session."""
    store = EventStore(spark, scratch_path(spark, label), REGISTRY)
    rows = techniques.tag_events(security_events(spark, sf))
    cut = F.lit("2024-01-21").cast("timestamp")
    store.append(rows.where(F.col("time") < cut), "testbed", run_id="base")
    store.append_replay(rows.where(F.col("time") >= cut), "session-1", run_id="replay")
    return store


@query(
    "store_scan",
    "SELECT class_uid, count(*) AS events, CAST(sum(bytes_out) AS BIGINT) AS bytes_out FROM ev "
    "WHERE event_time < TIMESTAMP '2024-01-21' GROUP BY class_uid",
    "ev",
)
def store_scan(spark, sf):
    store = _store(spark, sf, "scan")
    return (
        store.scan_all()
        .groupBy("class_uid")
        .agg(F.count(F.lit(1)).alias("events"), F.sum("network.bytes_out").alias("bytes_out"))
    )


@query(
    "replay_union",
    "SELECT activity_id, count(*) AS events, count(*) FILTER (event_time >= TIMESTAMP '2024-01-21') AS replayed "
    "FROM ev WHERE class_uid = 4001 GROUP BY activity_id",
    "ev",
)
def replay_union(spark, sf):
    both = _store(spark, sf, "replay").scan(4001, include_replay=True, session_id="session-1")
    late = F.count_if(F.col("time") >= F.lit("2024-01-21").cast("timestamp"))
    return both.groupBy("activity_id").agg(F.count(F.lit(1)).alias("events"), late.alias("replayed"))


@query(
    "store_query_where",
    "SELECT user_name, count(*) AS events FROM ev WHERE class_uid = 6003 AND auth_protocol = 'NTLM' "
    "AND event_time < TIMESTAMP '2024-01-21' GROUP BY user_name",
    "ev",
)
def store_query_where(spark, sf):
    rows = _store(spark, sf, "where").query_partition(6003, "auth.protocol = 'NTLM'")
    return rows.groupBy(F.col("actor.user.name").alias("user_name")).agg(F.count(F.lit(1)).alias("events"))


# -- rows ------------------------------------------------------------------------


@query(
    "class_projection",
    "SELECT strftime(event_time, '%Y-%m-%d %H:%M:%S') AS time, activity_id, severity_id, http_code, url_path, src_ip, "
    "dst_ip, dst_port FROM ev WHERE class_uid = 3002",
    "ev",
)
def class_projection(spark, sf):
    flat = event_ops.class_projection(security_events(spark, sf), 3002, REGISTRY)
    return flat.select(
        as_text_time("time").alias("time"),
        "activity_id",
        "severity_id",
        F.col("`http.response.code`").alias("http_code"),
        F.col("`http.request.url.path`").alias("url_path"),
        F.col("`src_endpoint.ip`").alias("src_ip"),
        F.col("`dst_endpoint.ip`").alias("dst_ip"),
        F.col("`dst_endpoint.port`").alias("dst_port"),
    )


@query(
    "display_events",
    "SELECT strftime(event_time, '%Y-%m-%d %H:%M:%S') AS time, class_uid, activity_id, severity_id, "
    "log_source AS metadata_log_source, user_name AS actor_user_name, src_ip AS src_endpoint_ip, "
    "dst_ip AS dst_endpoint_ip FROM ev",
    "ev",
)
def display_events(spark, sf):
    shown = event_ops.display_events(security_events(spark, sf))
    renamed = shown.toDF(*[c.replace(".", "_") for c in shown.columns])
    return renamed.withColumn("time", as_text_time("time"))


@query(
    "retype_rows",
    """
    SELECT CAST(CASE WHEN event_id % 4 = 1 OR activity_id IS NULL THEN 0 ELSE activity_id END AS INT) AS activity_id,
      severity_id, CASE WHEN event_id % 3 = 0 THEN 'unknown' ELSE log_source END AS log_source, bytes_out,
      strftime(event_time, '%Y-%m-%d %H:%M:%S') AS time
    FROM ev WHERE class_uid = 3001 AND event_id % 10 <> 7
    """,
    "ev",
)
def retype_rows(spark, sf):
    # text-typed rows with dirty values, as an untyped store would return them
    stored = flat_events(spark, sf).where("class_uid = 3001").select(
        F.when(F.col("event_id") % 4 == 1, "1.5").otherwise(F.col("activity_id").cast("string")).alias("activity_id"),
        F.when(F.col("event_id") % 10 == 7, "9").otherwise(F.col("severity_id").cast("string")).alias("severity_id"),
        F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss").alias("time"),
        F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("log_source")).alias("metadata.log_source"),
        F.col("bytes_out").cast("string").alias("network.bytes_out"),
        F.col("user_name").alias("actor.user.name"),
    )
    return normalize.retype_rows(stored, 3001, REGISTRY).select(
        "activity_id",
        "severity_id",
        F.col("metadata.log_source").alias("log_source"),
        F.col("network.bytes_out").alias("bytes_out"),
        as_text_time("time").alias("time"),
    )


_DIRTY_SQL = """
SELECT event_id, class_uid, event_time,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE activity_id END AS activity_id,
  CAST(severity_id + CASE event_id % 8 WHEN 1 THEN 5 WHEN 2 THEN -5 ELSE 0 END AS INT) AS severity_id,
  CASE WHEN event_id % 10 = 0 THEN NULL ELSE log_source END AS log_source,
  CASE event_id % 12 WHEN 0 THEN '999.1.1.1' WHEN 1 THEN '::1' WHEN 2 THEN 'abc' WHEN 3 THEN '01.2.3.4'
    WHEN 4 THEN 'fe80::1%eth0' WHEN 5 THEN '::ffff:1.2.3.4' ELSE src_ip END AS src_ip,
  CASE event_id % 11 WHEN 0 THEN '1:2:3:4:5:6:7:8:9' WHEN 1 THEN '1::' ELSE dst_ip END AS dst_ip,
  CAST(CASE event_id % 13 WHEN 0 THEN -1 WHEN 1 THEN 65536 WHEN 2 THEN 65535 WHEN 3 THEN 0 ELSE dst_port END AS INT) AS dst_port
FROM flat
"""


@query(
    "validation_report",
    f"""
    SELECT event_id, concat_ws(' ',
      CASE WHEN activity_id IS NULL THEN 'Required field ''activity_id'' is None.' END,
      CASE WHEN log_source IS NULL THEN 'Required field ''metadata.log_source'' is None.' END,
      CASE WHEN severity_id NOT BETWEEN 0 AND 6 THEN 'severity_id ' || severity_id || ' is out of range 0–6.' END,
      CASE WHEN src_ip IN ('999.1.1.1', 'abc', '01.2.3.4') THEN
        'Field ''src_endpoint.ip'' value ''' || src_ip || ''' is not a valid IPv4 or IPv6 address.' END,
      CASE WHEN dst_ip = '1:2:3:4:5:6:7:8:9' THEN
        'Field ''dst_endpoint.ip'' value ''' || dst_ip || ''' is not a valid IPv4 or IPv6 address.' END,
      CASE WHEN dst_port NOT BETWEEN 0 AND 65535 THEN
        'Field ''dst_endpoint.port'' value ''' || dst_port || ''' is not in range 0–65535.' END) AS errors
    FROM ({_DIRTY_SQL}) d
    """,
    "flat",
)
def validation_report(spark, sf):
    dirty = spark.sql(_DIRTY_SQL.replace("FROM flat", "FROM {flat}"), flat=flat_events(spark, sf))
    values = {
        "class_uid": F.col("class_uid"),
        "activity_id": F.col("activity_id"),
        "severity_id": F.col("severity_id"),
        "time": F.col("event_time").cast("timestamp"),
        "metadata.log_source": F.col("log_source"),
        "metadata.original_time": F.col("event_time").cast("string"),
        "src_endpoint.ip": F.col("src_ip"),
        "dst_endpoint.ip": F.col("dst_ip"),
        "dst_endpoint.port": F.col("dst_port"),
    }
    rows = dirty.select("event_id", *event_ops.event_columns(values, REGISTRY))
    return rows.select("event_id", F.array_join(normalize.validation_errors(), " ").alias("errors"))


@query(
    "time_coercion",
    f"""
    SELECT event_id, CASE event_id % 6 WHEN 0 THEN seconds WHEN 1 THEN seconds WHEN 2 THEN seconds - 7200
      WHEN 3 THEN seconds END AS seconds, event_id % 6 > 3 AS time_fallback
    FROM ({TIME_TEXT_SQL}) t
    """,
    "lines_base",
)
def time_coercion(spark, sf):
    moment = normalize.parse_time(F.col("t"))
    return lines(spark, sf, TIME_TEXT_SQL).select(
        "event_id", F.unix_seconds(moment).alias("seconds"), moment.isNull().alias("time_fallback")
    )


@query(
    "dedup_events",
    "SELECT class_uid, strftime(date_trunc('hour', event_time), '%Y-%m-%d %H:%M:%S') AS time, min(event_id) AS event_id "
    "FROM ev GROUP BY class_uid, date_trunc('hour', event_time)",
    "ev",
)
def dedup_events(spark, sf):
    hour = F.date_trunc("hour", "event_time").cast("timestamp_ntz")
    rows = nest(flat_events(spark, sf).withColumn("event_time", hour))
    return event_ops.dedup_events(rows, keep_first_by=["event_id"]).select(
        "class_uid", as_text_time("time").alias("time"), "event_id"
    )


@query("entities_distinct", "SELECT DISTINCT user_name AS entity_value FROM ev WHERE user_name IS NOT NULL", "ev")
def entities_distinct(spark, sf):
    return metrics.distinct_entities(security_events(spark, sf), "actor.user.name")


# -- techniques --------------------------------------------------------------------

_TECHNIQUE_CONDITIONS = {
    "T1078": "class_uid = 6003 AND activity_id = 1 AND severity_id = 1",
    "T1110": "class_uid = 6003 AND activity_id = 2 AND severity_id = 3",
    "T1110.001": "class_uid = 6003 AND activity_id = 2 AND lower(auth_protocol) = 'ntlm'",
    "T1078.002": "class_uid = 6003 AND activity_id = 1 AND contains(user_name, chr(92))",
    "T1059": "class_uid = 4001 AND (contains(lower(actor_process), 'cmd.exe') OR contains(lower(actor_process), 'powershell'))",
    "T1059.001": "class_uid = 4001 AND contains(lower(actor_process), 'powershell')",
    "T1055": "class_uid = 4001 AND contains(lower(actor_process), 'svchost') AND child_process IS NOT NULL",
    "T1053": "class_uid = 4001 AND (contains(lower(actor_process), 'schtasks') OR contains(lower(actor_process), 'at.exe'))",
    "T1071": "class_uid = 3001 AND dst_port IN (80, 443)",
    "T1048": "class_uid = 3001 AND bytes_out > 10000000",
    "T1090": "class_uid = 3001 AND dst_port > 8080",
    "T1046": "class_uid = 3001 AND dst_port IS NOT NULL AND bytes_out = 0",
    "T1190": "class_uid = 3002 AND contains(CAST(http_code AS STRING), '5')",
    "T1059.007": "class_uid = 3002 AND contains(lower(url_path), '<script')",
    "T1005": "class_uid = 1001 AND (contains(lower(file_path), '\\windows\\system32')"
    " OR contains(lower(file_path), '/etc/passwd') OR contains(lower(file_path), '/etc/shadow'))",
    "T1070.004": "class_uid = 1001 AND activity_id = 4",
}
_TAGGED = "(" + " UNION ALL ".join(
    f"SELECT event_id, class_uid, event_time, '{t}' AS technique_id FROM ev WHERE {c}"
    for t, c in _TECHNIQUE_CONDITIONS.items()
) + ") t"


@query(
    "tag_techniques",
    f"SELECT event_id, string_agg(technique_id, ',' ORDER BY technique_id) AS techniques FROM {_TAGGED} GROUP BY event_id",
    "ev",
)
def tag_techniques(spark, sf):
    tagged = techniques.tag_events(security_events(spark, sf)).where("mitre_technique_ids IS NOT NULL")
    return tagged.select("event_id", F.array_join(F.array_sort("mitre_technique_ids"), ",").alias("techniques"))


@query("technique_counts", f"SELECT technique_id, count(*) AS events FROM {_TAGGED} GROUP BY technique_id", "ev")
def technique_counts(spark, sf):
    return techniques.count_techniques(techniques.tag_events(security_events(spark, sf)))


@query(
    "technique_hourly",
    "SELECT class_uid, technique_id, strftime(date_trunc('hour', event_time), '%Y-%m-%d %H:%M:%S') AS hour, "
    f"count(*) AS events FROM {_TAGGED} GROUP BY ALL",
    "ev",
)
def technique_hourly(spark, sf):
    tagged = techniques.tag_events(security_events(spark, sf))
    hourly = techniques.count_techniques(tagged, "class_uid", F.date_trunc("hour", "time").alias("hour"))
    return hourly.withColumn("hour", as_text_time("hour")).orderBy("hour", "class_uid", "technique_id")


@query(
    "class_technique_sets",
    "SELECT class_uid, count(*) AS events, CASE class_uid "
    "WHEN 1001 THEN 'T1005,T1070.004' WHEN 3001 THEN 'T1046,T1048,T1071,T1090' WHEN 3002 THEN 'T1059.007,T1190' "
    "WHEN 4001 THEN 'T1053,T1055,T1059,T1059.001' ELSE 'T1078,T1078.002,T1110,T1110.001' END AS techniques "
    "FROM ev GROUP BY class_uid",
    "ev",
)
def class_technique_sets(spark, sf):
    per_class = security_events(spark, sf).groupBy("class_uid").agg(F.count(F.lit(1)).alias("events"))
    return per_class.join(techniques.techniques_by_class(spark), "class_uid").select(
        "class_uid", "events", F.array_join("technique_ids", ",").alias("techniques")
    )


# -- metrics -------------------------------------------------------------------------

_FLAT_NAMES = {
    "actor.user.name": "user_name",
    "src_endpoint.ip": "src_ip",
    "src_endpoint.hostname": "src_hostname",
    "actor.process.name": "actor_process",
    "dst_endpoint.port": "dst_port",
    "network.bytes_out": "bytes_out",
}
_RATE = (
    "CASE WHEN count(*) >= 2 AND max(event_time) > min(event_time) THEN "
    "count(*) / ((epoch_us(max(event_time)) - epoch_us(min(event_time))) / 3600000000.0) END"
)


def _metric_sql(metric) -> str:
    target = _FLAT_NAMES.get(metric.target_field)
    value = {
        "count": "CAST(count(*) AS DOUBLE)",
        "distinct_field_count": f"CAST(count(DISTINCT {target}) AS DOUBLE)",
        "sum_field": f"coalesce(CAST(sum({target}) AS DOUBLE), 0.0)",
        "rate_per_hour": _RATE,
    }[metric.computation]
    field = _FLAT_NAMES[metric.entity_field]
    return (
        f"SELECT '{metric.entity_type}' AS entity_type, {field} AS entity_value, '{metric.metric_name}' AS metric_name, "
        f"CAST({metric.class_uid} AS INT) AS class_uid, round({value}, 4) AS value FROM ev "
        f"WHERE class_uid = {metric.class_uid} AND {field} IS NOT NULL GROUP BY {field}"
    )


def _register_metric(metric) -> None:
    def build(spark, sf):
        return metrics.metric_by_entity(security_events(spark, sf), metric).select(
            "entity_value", F.round("value", 4).alias("value")
        )

    query(f"metric_{metric.metric_name}", f"SELECT entity_value, value FROM ({_metric_sql(metric)}) m", "ev")(build)


for _metric in METRICS.all():
    _register_metric(_metric)


@query("metrics_all", " UNION ALL ".join(_metric_sql(m) for m in METRICS.all()), "ev")
def metrics_all(spark, sf):
    return metrics.all_metrics(security_events(spark, sf)).withColumn("value", F.round("value", 4))


@query(
    "metric_overall",
    f"SELECT round({_RATE}, 4) AS value FROM ev WHERE class_uid = 6003",
    "ev",
)
def metric_overall(spark, sf):
    value = metrics.metric_overall(security_events(spark, sf), "auth_count_per_hour", 6003)
    return value.select(F.round("value", 4).alias("value"))


# -- baselines and anomalies ------------------------------------------------------------

_BASE_EVENT = """
SELECT src_ip AS entity_value, avg(bytes_out) AS mean, stddev_samp(bytes_out) AS stddev, count(*) AS observation_count,
  strftime(min(event_time), '%Y-%m-%dT%H:%M:%SZ') AS window_start, strftime(max(event_time), '%Y-%m-%dT%H:%M:%SZ') AS window_end
FROM ev WHERE class_uid = 3001 {extra} GROUP BY src_ip HAVING count(*) >= 30
"""
_ROUNDED = (
    "SELECT entity_value, round(mean, 3) AS mean, round(stddev, 3) AS stddev, observation_count, window_start, window_end "
)
def _rounded(rows):
    return rows.select(
        "entity_value",
        F.round("mean", 3).alias("mean"),
        F.round("stddev", 3).alias("stddev"),
        "observation_count",
        "window_start",
        "window_end",
    )


@query("baseline_per_event", f"{_ROUNDED} FROM ({_BASE_EVENT.format(extra='')}) b", "ev")
def baseline_per_event(spark, sf):
    return _rounded(baselines.per_event_baseline(security_events(spark, sf), BYTES_OUT))


_HOURS = """
hours AS (
  SELECT user_name AS entity_value, date_trunc('hour', event_time) AS hour, CAST(count(*) AS DOUBLE) AS value,
    min(event_time) AS first_time, max(event_time) AS last_time
  FROM ev WHERE class_uid = 4001 AND user_name IS NOT NULL GROUP BY ALL),
edge AS (SELECT max(hour) AS hour FROM hours),
hourly AS (
  SELECT entity_value, avg(value) AS mean, stddev_samp(value) AS stddev, count(*) AS observation_count,
    strftime(min(first_time), '%Y-%m-%dT%H:%M:%SZ') AS window_start,
    strftime(max(last_time), '%Y-%m-%dT%H:%M:%SZ') AS window_end
  FROM hours WHERE hour < (SELECT hour FROM edge) GROUP BY entity_value HAVING count(*) >= 30)
"""


def _with_hours(text: str) -> str:
    """An oracle text that reads the hourly values defined after the event names."""
    head = oracle("", "ev").rstrip()
    return f"{head}, {_HOURS} {text}"


@query("baseline_hourly", _with_hours(f"{_ROUNDED} FROM hourly"))
def baseline_hourly(spark, sf):
    return _rounded(baselines.hourly_baseline(security_events(spark, sf), PROCESS_COUNT))


@query(
    "baseline_hourly_zero_fill",
    _with_hours(
        """
        , spans AS (SELECT entity_value, min(hour) AS lo, max(hour) AS hi, min(first_time) AS ft, max(last_time) AS lt
          FROM hours WHERE hour < (SELECT hour FROM edge) GROUP BY entity_value),
        grid AS (SELECT entity_value, ft, lt, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS hour FROM spans)
        SELECT g.entity_value, round(avg(coalesce(h.value, 0)), 3) AS mean, round(stddev_samp(coalesce(h.value, 0)), 3) AS stddev,
          count(*) AS observation_count, strftime(min(ft), '%Y-%m-%dT%H:%M:%SZ') AS window_start,
          strftime(max(lt), '%Y-%m-%dT%H:%M:%SZ') AS window_end
        FROM grid g LEFT JOIN hours h ON h.entity_value = g.entity_value AND h.hour = g.hour
        GROUP BY g.entity_value HAVING count(*) >= 30
        """
    ),
)
def baseline_hourly_zero_fill(spark, sf):
    return _rounded(baselines.hourly_baseline(security_events(spark, sf), PROCESS_COUNT, zero_fill=True))


_EVENT_Z = f"""
SELECT e.event_id, e.src_ip AS entity_value, CAST(e.bytes_out AS DOUBLE) AS current_value,
  CASE WHEN b.stddev = 0 THEN CASE WHEN e.bytes_out = b.mean THEN 0.0 ELSE 4.0 END
  ELSE (e.bytes_out - b.mean) / b.stddev END AS z_score, b.mean
FROM ev e JOIN ({_BASE_EVENT.format(extra='')}) b ON b.entity_value = e.src_ip WHERE e.class_uid = 3001
"""


@query(
    "anomaly_zscore",
    f"SELECT event_id, entity_value, current_value, round(z_score, 4) AS z_score, abs(z_score) > 3.0 AS is_anomaly FROM ({_EVENT_Z}) z",
    "ev",
)
def anomaly_zscore(spark, sf):
    found = behaviour.event_anomalies(security_events(spark, sf), BYTES_OUT, "event_id")
    return found.select("event_id", "entity_value", "current_value", F.round("z_score", 4).alias("z_score"), "is_anomaly")


@query(
    "anomaly_hourly",
    _with_hours(
        """
        SELECT h.entity_value, h.value AS current_value, round((h.value - b.mean) / b.stddev, 4) AS z_score,
          abs((h.value - b.mean) / b.stddev) > 3.0 AS is_anomaly
        FROM hours h JOIN hourly b ON b.entity_value = h.entity_value WHERE h.hour = (SELECT hour FROM edge) AND b.stddev <> 0
        UNION ALL
        SELECT h.entity_value, h.value, CASE WHEN h.value = b.mean THEN 0.0 ELSE 4.0 END, h.value <> b.mean
        FROM hours h JOIN hourly b ON b.entity_value = h.entity_value WHERE h.hour = (SELECT hour FROM edge) AND b.stddev = 0
        """
    ),
)
def anomaly_hourly(spark, sf):
    found = behaviour.hourly_anomalies(security_events(spark, sf), PROCESS_COUNT)
    return found.select("entity_value", "current_value", F.round("z_score", 4).alias("z_score"), "is_anomaly")


@query(
    "anomaly_messages",
    f"""
    SELECT event_id, '[LLM unavailable] Anomaly detected: net_bytes_out_per_hour for ip=' || entity_value || ' deviated ' ||
      printf('%.2f', z_score) || ' standard deviations from the baseline mean of ' || printf('%.4f', mean) ||
      ' (current value: ' || printf('%.4f', current_value) || ').' AS message
    FROM ({_EVENT_Z}) z WHERE abs(z_score) > 3.0
    """,
    "ev",
)
def anomaly_messages(spark, sf):
    found = behaviour.event_anomalies(security_events(spark, sf), BYTES_OUT, "event_id").where("is_anomaly")
    return found.select("event_id", anomalies.anomaly_message().alias("message"))


@query(
    "baseline_upsert",
    f"""
    SELECT entity_value, round(mean, 3) AS mean, observation_count FROM (
      SELECT * FROM ({_BASE_EVENT.format(extra="AND event_time < TIMESTAMP '2024-01-16'")}) o
        WHERE entity_value NOT IN (SELECT entity_value FROM ({_BASE_EVENT.format(extra="AND event_time >= TIMESTAMP '2024-01-14'")}) n)
      UNION ALL SELECT * FROM ({_BASE_EVENT.format(extra="AND event_time >= TIMESTAMP '2024-01-14'")}) n) u
    """,
    "ev",
)
def baseline_upsert(spark, sf):
    rows = security_events(spark, sf)
    store = BaselineStore(spark, scratch_path(spark, "baselines"))
    store.upsert(baselines.per_event_baseline(rows.where(F.col("time") < F.lit("2024-01-16").cast("timestamp")), BYTES_OUT))
    now = store.upsert(
        baselines.per_event_baseline(rows.where(F.col("time") >= F.lit("2024-01-14").cast("timestamp")), BYTES_OUT)
    )
    return now.select("entity_value", F.round("mean", 3).alias("mean"), "observation_count")


@query("baseline_merge", f"{_ROUNDED} FROM ({_BASE_EVENT.format(extra='')}) b", "ev")
def baseline_merge(spark, sf):
    """Baselines out of stored moments, which come day by day; a day that comes twice counts once."""
    rows = security_events(spark, sf)
    store = MomentStore(spark, scratch_path(spark, "moments"))
    for first, last in (("2024-01-01", "2024-01-11"), ("2024-01-11", "2024-01-21"), ("2024-01-18", "2024-01-21"), ("2024-01-21", "2025-01-01")):
        days = rows.where((F.col("time") >= F.lit(first).cast("timestamp")) & (F.col("time") < F.lit(last).cast("timestamp")))
        store.put_days(moments.daily_event_moments(days, BYTES_OUT))
    return _rounded(store.baselines())


@query("baseline_merge_hourly", _with_hours(f"{_ROUNDED} FROM hourly"))
def baseline_merge_hourly(spark, sf):
    """The hourly reading: moments of entity-hours, without the newest hour."""
    rows = security_events(spark, sf)
    hours = settled(baselines.hourly_values(rows, PROCESS_COUNT), "hours")
    earlier = hours.where(F.col("hour") < hours.agg(F.max("hour")).scalar())
    store = MomentStore(spark, scratch_path(spark, "hour-moments"))
    cut = F.lit("2024-01-13").cast("timestamp")
    store.put_days(moments.daily_hour_moments(earlier.where(F.col("hour") < cut), PROCESS_COUNT))
    store.put_days(moments.daily_hour_moments(earlier.where(F.col("hour") >= cut), PROCESS_COUNT))
    return _rounded(store.baselines())


_BY_SOURCE = MetricDefinition("bytes_values", 3001, "source", "metadata.log_source", "distinct_field_count", "network.bytes_out")


@query(
    "distinct_sketch_days",
    """
    SELECT log_source AS entity_value, count(DISTINCT bytes_out) AS values, true AS days_within_2_percent, true AS one_pass_within_2_percent
    FROM ev WHERE class_uid = 3001 GROUP BY log_source
    """,
    "ev",
)
def distinct_sketch_days(spark, sf):
    """Sketches of days, stored and united, against the exact number and against one pass over all events."""
    rows = security_events(spark, sf)
    store = SketchStore(spark, scratch_path(spark, "sketches"))
    cut = F.lit("2024-01-15").cast("timestamp")
    for part in (rows.where(F.col("time") < cut), rows.where(F.col("time") >= cut)):
        store.put_days(sketches.daily_sketches(part, _BY_SOURCE))
    united = sketches.distinct_counts(store.read()).select("entity_value", F.col("value").alias("days"))
    once = sketches.distinct_counts_once(rows, _BY_SOURCE).withColumnRenamed("value", "once")
    exact = metrics.metric_by_entity(rows, _BY_SOURCE).join(united, "entity_value").join(once, "entity_value")
    near = lambda name: F.abs(F.col(name) - F.col("value")) <= 0.02 * F.col("value")
    return exact.select(
        "entity_value", F.col("value").cast("bigint").alias("values"), near("days").alias("days_within_2_percent"), near("once").alias("one_pass_within_2_percent")
    )


@query(
    "baseline_lookup",
    f"""
    SELECT k.entity_value, round(b.mean, 3) AS mean FROM (SELECT DISTINCT src_ip AS entity_value FROM ev WHERE class_uid IN (3001, 3002)) k
    LEFT JOIN ({_BASE_EVENT.format(extra='')}) b ON b.entity_value = k.entity_value WHERE k.entity_value IS NOT NULL
    """,
    "ev",
)
def baseline_lookup(spark, sf):
    rows = security_events(spark, sf)
    keys = metrics.distinct_entities(rows.where("class_uid IN (3001, 3002)"), "src_endpoint.ip").select(
        F.lit("ip").alias("entity_type"), "entity_value", F.lit(BYTES_OUT.metric_name).alias("metric_name"), F.lit(3001).alias("class_uid")
    )
    found = baselines.lookup_baselines(keys, baselines.per_event_baseline(rows, BYTES_OUT))
    return found.select("entity_value", F.round("mean", 3).alias("mean"))


# -- timelines ---------------------------------------------------------------------------


def _timeline_sql(minutes: int) -> str:
    return f"""
    SELECT strftime(date_trunc('day', event_time) +
      to_minutes(CAST(floor((date_part('hour', event_time) * 60 + date_part('minute', event_time)) / {minutes}) * {minutes} AS INT)),
      '%Y-%m-%d %H:%M') AS timestamp, count(*) AS count FROM ev GROUP BY 1
    """


@query("timeline_30m", _timeline_sql(30), "ev")
def timeline_30m(spark, sf):
    return timeline.timeline(security_events(spark, sf), 30)


@query("timeline_7m", _timeline_sql(7), "ev")
def timeline_7m(spark, sf):
    return timeline.timeline(security_events(spark, sf), 7)
