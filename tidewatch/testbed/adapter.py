"""The test tables seen as security events.

The SQL texts run unchanged on Spark and on DuckDB, so the oracle sees the same
rows that Spark nests into the event schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tidewatch.registry import FieldRegistry
from tidewatch.session import configure

# Flat security columns derived from the ``events`` table.
FLAT_EVENTS_SQL = """
SELECT event_id,
  CAST(CASE event_type WHEN 'purchase' THEN 3001 WHEN 'view' THEN 3002 WHEN 'click' THEN 4001
       WHEN 'signup' THEN 6003 ELSE 1001 END AS INT) AS class_uid,
  CAST(event_id % 5 AS INT) AS activity_id,
  CAST(event_id % 7 AS INT) AS severity_id,
  ts AS event_time,
  'testbed' AS log_source,
  CASE WHEN event_id % 11 = 0 THEN 'CORP' || chr(92) ELSE '' END || 'user' || CAST(user_id % 40 AS STRING) AS user_name,
  '10.0.0.' || CAST(user_id % 61 AS STRING) AS src_ip,
  'host' || CAST(user_id % 17 AS STRING) AS src_hostname,
  '192.168.1.' || CAST(event_id % 23 AS STRING) AS dst_ip,
  CAST(CASE event_id % 6 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 22 WHEN 3 THEN 9001 WHEN 4 THEN 8080 END AS INT) AS dst_port,
  CASE WHEN event_id % 17 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(floor(value * 100000) AS BIGINT) END AS bytes_out,
  CASE event_id % 8 WHEN 0 THEN 'cmd.exe' WHEN 1 THEN 'PowerShell.exe' WHEN 2 THEN 'svchost.exe'
       WHEN 3 THEN 'schtasks.exe' WHEN 4 THEN 'at.exe' ELSE 'bash' END AS actor_process,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'child' END AS child_process,
  CASE WHEN event_id % 3 = 0 THEN 'NTLM' ELSE 'Kerberos' END AS auth_protocol,
  CAST(CASE event_id % 4 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 500 ELSE 205 END AS INT) AS http_code,
  CASE WHEN event_id % 13 = 0 THEN '/q?<SCRIPT>' ELSE '/index' END AS url_path,
  CASE event_id % 9 WHEN 0 THEN '/etc/passwd' WHEN 1 THEN '/etc/shadow'
       WHEN 2 THEN 'C:' || chr(92) || 'Windows' || chr(92) || 'System32' || chr(92) || 'x.dll' ELSE '/tmp/x' END AS file_path
FROM events
"""

# flat column -> event path
FLAT_TO_PATH = {
    "user_name": "actor.user.name",
    "src_ip": "src_endpoint.ip",
    "src_hostname": "src_endpoint.hostname",
    "dst_ip": "dst_endpoint.ip",
    "dst_port": "dst_endpoint.port",
    "bytes_out": "network.bytes_out",
    "actor_process": "actor.process.name",
    "child_process": "process.name",
    "auth_protocol": "auth.protocol",
    "http_code": "http.response.code",
    "url_path": "http.request.url.path",
    "file_path": "file.path",
}

REGISTRY = FieldRegistry.default()


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table. Its schema is looked up once per process, not once per query."""
    configure(spark)
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def flat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FLAT_EVENTS_SQL.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


def _nested_sql() -> list[str]:
    """The event columns as SQL text: one named_struct per group, typed nulls where there is no source."""
    values = {
        "class_uid": "class_uid",
        "activity_id": "activity_id",
        "severity_id": "severity_id",
        "time": "CAST(event_time AS TIMESTAMP)",
        "metadata.log_source": "log_source",
        "metadata.original_time": "date_format(event_time, 'yyyy-MM-dd HH:mm:ss')",
    }
    for name, path in FLAT_TO_PATH.items():
        classes = ", ".join(map(str, REGISTRY.get_field_definition(path).applicable_classes))
        values[path] = f"CASE WHEN class_uid IN ({classes}) THEN {name} END"

    def build(node, path: str) -> str:
        if isinstance(node, dict):
            return "named_struct(" + ", ".join(f"'{n}', {build(sub, f'{path}.{n}')}" for n, sub in node.items()) + ")"
        return f"CAST({values.get(path, 'NULL')} AS {node.spark_type.simpleString()})"

    return [f"{build(node, name)} AS {name}" for name, node in REGISTRY.tree().items()]


_NESTED = _nested_sql()


def nest(flat: DataFrame) -> DataFrame:
    """Flat columns -> event rows; fields of other classes become null. ``event_id`` stays as row key."""
    return flat.selectExpr("event_id", *_NESTED)


def security_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nest(flat_events(spark, sf_dir))
