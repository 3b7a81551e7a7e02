"""More tables derived from the test data by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import scratch_path
from tidewatch.testbed.adapter import FLAT_EVENTS_SQL, table

# Rule submissions: every order is one version of its customer's rule.
SUBMISSIONS_SQL = """
SELECT 'rule-' || CAST(o_custkey AS STRING) AS rule_id,
  'title: rule ' || CAST(o_custkey AS STRING) || chr(10) || 'tags:' || chr(10) || '  - attack.' ||
  CASE o_orderkey % 9 WHEN 0 THEN 'T1059.001' WHEN 1 THEN 'T1078' WHEN 2 THEN 'T1005' ELSE 'T9999' END || chr(10) ||
  'detection:' || chr(10) || '  keywords:' || chr(10) ||
  '    - User' || CAST(o_orderkey % 40 AS STRING) || chr(10) ||
  '    - "10.0.0.' || CAST(o_custkey % 61 AS STRING) || '"' || chr(10) ||
  'falsepositives:' || chr(10) || '  - none' AS yaml_content,
  o_orderdate AS submitted_at, o_orderkey, o_custkey
FROM orders
"""

# A third of the rules have their latest version confirmed, a third only version 1.
CONFIRMATIONS_SQL = """
SELECT rule_id, CAST(CASE WHEN o_custkey % 3 = 0 THEN count(*) ELSE 1 END AS INT) AS version,
  max(submitted_at) AS confirmed_at
FROM submissions WHERE o_custkey % 3 < 2 GROUP BY rule_id, o_custkey
"""

QUERY_AUDIT_SQL = """
SELECT CAST(o_orderkey AS STRING) AS entry_id, 'session-' || CAST(o_custkey AS STRING) AS session_id,
  o_orderpriority AS sql_template, CAST(3001 AS INT) AS event_class,
  o_orderstatus <> 'F' AS success, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS latency_ms,
  o_orderdate AS executed_at
FROM orders
"""

INGEST_AUDIT_SQL = """
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS entry_id,
  CASE l_orderkey % 5 WHEN 0 THEN 'zeek' WHEN 1 THEN 'Apache' WHEN 2 THEN 'evtx' WHEN 3 THEN 'syslog' ELSE 'other' END AS source_format,
  CAST(floor(l_quantity) AS BIGINT) AS event_count, l_shipdate AS ingested_at
FROM lineitem
"""

# Lines of indicator files, one file per market segment.
INDICATOR_LINES_SQL = """
SELECT CASE c_custkey % 6
    WHEN 0 THEN '10.0.0.' || CAST(c_nationkey * 3 AS STRING)
    WHEN 1 THEN '  192.168.1.' || CAST(c_nationkey * 2 AS STRING) || ' '
    WHEN 2 THEN 'corp' || chr(92) || 'USER' || CAST(c_nationkey AS STRING)
    WHEN 3 THEN '/ETC/SHADOW'
    WHEN 4 THEN '# ' || c_name
    ELSE '' END AS value,
  c_mktsegment AS file_path, CAST(floor(c_custkey / 100) AS BIGINT) AS block_start, c_custkey AS seq
FROM customer
"""

_NOISE = "'garbage ' || CAST(event_id AS STRING)"

APACHE_LINES_SQL = f"""
SELECT event_id, CASE WHEN event_id % 50 = 0 THEN {_NOISE} ELSE
  src_ip || ' - ' || user_name || ' [' || stamp || ' +0000] "GET ' || url_path || ' HTTP/1.1" ' ||
  CAST(http_code AS STRING) || ' ' || CASE WHEN event_id % 17 = 0 THEN '-' ELSE CAST(bytes_out AS STRING) END ||
  CASE WHEN event_id % 2 = 0 THEN ' "http://ref/' || CAST(event_id AS STRING) || '" "agent ' || actor_process || '"' ELSE '' END
  END AS value
FROM lines_base
"""

ZEEK_ROW = """
  CAST(seconds AS STRING) || '.5' || chr(9) || 'C' || CAST(event_id AS STRING) || chr(9) || src_ip || chr(9) ||
  CAST(1024 + event_id % 1000 AS STRING) || chr(9) || dst_ip || chr(9) ||
  CASE WHEN dst_port IS NULL THEN '-' ELSE CAST(dst_port AS STRING) END || chr(9) || 'tcp' || chr(9) || '-' || chr(9) ||
  CAST(event_id % 9 AS STRING) || '.25' || chr(9) || CAST(bytes_out AS STRING) || chr(9) || '0' || chr(9) || 'SF' ||
  chr(9) || CAST(event_id % 8 AS STRING) || chr(9) || '-' || chr(9) ||
  CASE event_id % 10 WHEN 0 THEN '1.5' WHEN 1 THEN '-' ELSE ' 2' END ||
  chr(9) || '-' || chr(9) || '-' || chr(9) || '-' || chr(9) || '-' || chr(9) || '-' || chr(9) || 'x'
"""

ZEEK_LINES_SQL = f"""
SELECT event_id, CASE WHEN event_id % 50 = 0 THEN {_NOISE} ELSE {ZEEK_ROW} END AS value
FROM lines_base
"""

EVTX_SQL = f"""
SELECT event_id, CASE WHEN event_id % 50 = 0 THEN '<broken ' || {_NOISE} ELSE
  '<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><EventID>' ||
  CAST(4624 + event_id % 2 AS STRING) || '</EventID><TimeCreated SystemTime="' || iso || 'Z"/><Computer>' ||
  src_hostname || '</Computer></System><EventData><Data Name="SubjectUserName">' || user_name ||
  '</Data><Data Name="IpAddress">' || src_ip || '</Data><Data>unnamed</Data><Data Name="AuthenticationPackageName">' ||
  auth_protocol || '</Data></EventData></Event>' END AS value
FROM lines_base
"""

# Syslog lines whose messages are whole documents on one line.
SYSLOG_LINES_SQL = """
SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'garbage ' || CAST(doc_id AS STRING) ELSE
  CASE WHEN doc_id % 2 = 0 THEN '<34>' ELSE '' END || 'Jan ' || CAST(1 + doc_id % 28 AS STRING) || ' 06:0' ||
  CAST(doc_id % 10 AS STRING) || ':00 host' || CAST(doc_id % 17 AS STRING) || ' sshd' ||
  CASE WHEN doc_id % 3 = 0 THEN '[' || CAST(doc_id AS STRING) || ']' ELSE '' END || ': m ' ||
  replace(text, chr(10), ' ') || ' .' END AS value
FROM documents
"""

INTENT_SQL = """
SELECT event_id, CASE event_id % 7
  WHEN 0 THEN 'no json at all'
  WHEN 1 THEN '```json' || chr(10) || body || chr(10) || '```'
  ELSE body END AS response
FROM (SELECT event_id, '{"class_uid": ' || CASE WHEN event_id % 5 = 0 THEN 'null' ELSE CAST(class_uid AS STRING) END ||
  ', "filters": [{"field_path": "src_endpoint.ip", "operator": "eq", "value": "' || src_ip ||
  '"}, {"field_path": "x", "operator": "like", "value": 1}], "time_range_hours": ' ||
  CAST(event_id % 4 AS STRING) || ', "confidence": ' || CAST(event_id % 3 AS STRING) || '.5}' AS body FROM flat) b
"""

TIME_TEXT_SQL = """
SELECT event_id, seconds, CASE event_id % 6
  WHEN 0 THEN CAST(seconds AS STRING) || '.0'
  WHEN 1 THEN iso || 'Z'
  WHEN 2 THEN iso || '+02:00'
  WHEN 3 THEN replace(iso, 'T', ' ')
  WHEN 4 THEN 'bad' END AS t
FROM lines_base
"""


def _lines_base_spark() -> str:
    return (
        "SELECT *, unix_seconds(CAST(event_time AS TIMESTAMP)) AS seconds,"
        " date_format(event_time, 'dd/MMM/yyyy:HH:mm:ss') AS stamp,"
        " date_format(event_time, \"yyyy-MM-dd'T'HH:mm:ss\") AS iso FROM flat"
    )


LINES_BASE_DUCKDB = (
    "SELECT *, CAST(floor(epoch_us(event_time) / 1000000) AS BIGINT) AS seconds,"
    " strftime(event_time, '%d/%b/%Y:%H:%M:%S') AS stamp,"
    " strftime(event_time, '%Y-%m-%dT%H:%M:%S') AS iso FROM flat"
)


def sql(spark: SparkSession, sf_dir: str, text: str, *sources: str) -> DataFrame:
    """Run a text over test tables and the derived names it builds on."""
    ctes = {
        "flat": FLAT_EVENTS_SQL.replace("FROM events", "FROM {events}"),
        "lines_base": _lines_base_spark(),
        "submissions": SUBMISSIONS_SQL.replace("FROM orders", "FROM {orders}"),
    }
    needs = {"flat": "events", "submissions": "orders"}
    frames, parts = {}, []
    text = text.replace("{", "{{").replace("}", "}}")  # spark.sql formats the text
    for name in sources:
        if name in ctes:
            parts.append(f"{name} AS ({ctes[name]})")
            if name in needs:
                frames[needs[name]] = table(spark, sf_dir, needs[name])
        else:
            frames[name] = table(spark, sf_dir, name)
            text = text.replace(f"FROM {name}", f"FROM {{{name}}}")
    head = f"WITH {', '.join(parts)} " if parts else ""
    return spark.sql(head + text, **frames)


def written(rows: DataFrame, label: str) -> DataFrame:
    """Rows written to the shared folder and read back, as logs lie in files."""
    path = scratch_path(rows.sparkSession, label)
    rows.repartition(rows.sparkSession.sparkContext.defaultParallelism).write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def lines(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return written(sql(spark, sf_dir, text, "flat", "lines_base"), "lines")


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, "SELECT * FROM submissions", "submissions")


def confirmations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, CONFIRMATIONS_SQL, "submissions")


def query_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, QUERY_AUDIT_SQL, "orders")


def ingest_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, INGEST_AUDIT_SQL, "lineitem")


def indicator_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, INDICATOR_LINES_SQL, "customer")


def as_text_time(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss")
