"""Queries that parse and normalise generated log lines, in batch and as streams."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from tidewatch.operators import normalize, parse
from tidewatch.operators.normalize import FieldMapping, MappingRegistry
from tidewatch.plans import ingest
from tidewatch.session import scratch_path
from tidewatch.sources.store import EventStore
from tidewatch.streaming import detect
from tidewatch.streaming.ingest import start_ingest, stream_lines
from tidewatch.testbed import derived
from tidewatch.testbed.adapter import FLAT_EVENTS_SQL, REGISTRY, nest, table
from tidewatch.testbed.catalog import query
from tidewatch.testbed.derived import as_text_time
from tidewatch.testbed.detection_queries import _iocs as indicators_from_customers

_AT = datetime(2026, 1, 1, tzinfo=timezone.utc)


def _positioned(lines):
    """Lines as if read from files: seven files, cut into blocks."""
    return lines.select(
        "*",
        F.concat(F.lit("file-"), (F.col("event_id") % 7).cast("string")).alias("file_path"),
        F.floor(F.col("event_id") / 700).alias("block_start"),
        (F.col("event_id") * 10).alias("seq"),
    )


# -- parsers ------------------------------------------------------------------------


@query(
    "parse_apache",
    """
    SELECT event_id, event_id % 50 <> 0 AS parsed,
      CASE WHEN event_id % 50 <> 0 THEN src_ip END AS client_ip, CASE WHEN event_id % 50 <> 0 THEN user_name END AS user,
      CASE WHEN event_id % 50 <> 0 THEN stamp || ' +0000' END AS time, CASE WHEN event_id % 50 <> 0 THEN url_path END AS uri,
      CASE WHEN event_id % 50 <> 0 THEN CAST(http_code AS STRING) END AS status,
      CASE WHEN event_id % 50 <> 0 AND event_id % 17 <> 0 THEN CAST(bytes_out AS STRING) END AS bytes,
      CASE WHEN event_id % 50 <> 0 AND event_id % 2 = 0 THEN 'agent ' || actor_process END AS user_agent
    FROM lines_base
    """,
    "lines_base",
)
def parse_apache(spark, sf):
    parsed = parse.parse_apache(derived.lines(spark, sf, derived.APACHE_LINES_SQL))
    fields = ["client_ip", "user", "time", "uri", "status", "bytes", "user_agent"]
    return parsed.select("event_id", F.col("is_parsed").alias("parsed"), *[f"raw.{f}" for f in fields])


@query(
    "parse_syslog",
    """
    SELECT doc_id, CASE WHEN doc_id % 50 <> 0 AND doc_id % 2 = 0 THEN '34' END AS priority,
      CASE WHEN doc_id % 50 <> 0 THEN CAST(1 + doc_id % 28 AS STRING) END AS day,
      CASE WHEN doc_id % 50 <> 0 THEN '06:0' || CAST(doc_id % 10 AS STRING) || ':00' END AS time,
      CASE WHEN doc_id % 50 <> 0 THEN 'host' || CAST(doc_id % 17 AS STRING) END AS hostname,
      CASE WHEN doc_id % 50 <> 0 THEN 'sshd' END AS process,
      CASE WHEN doc_id % 50 <> 0 AND doc_id % 3 = 0 THEN CAST(doc_id AS STRING) END AS pid,
      CASE WHEN doc_id % 50 <> 0 THEN 'm ' || replace(text, chr(10), ' ') || ' .' END AS message
    FROM documents
    """,
)
def parse_syslog(spark, sf):
    parsed = parse.parse_syslog(derived.written(derived.sql(spark, sf, derived.SYSLOG_LINES_SQL, "documents"), "syslog"))
    fields = ["priority", "day", "time", "hostname", "process", "pid", "message"]
    return parsed.select("doc_id", *[f"raw.{f}" for f in fields])


_ZEEK_ORACLE = """
    SELECT event_id, CASE WHEN event_id % 50 <> 0 THEN CAST(seconds AS STRING) || '.5' END AS ts,
      CASE WHEN event_id % 50 <> 0 THEN src_ip END AS orig_h,
      CASE WHEN event_id % 50 <> 0 THEN CAST(dst_port AS STRING) END AS resp_p,
      CASE WHEN event_id % 50 <> 0 THEN CAST(bytes_out AS STRING) END AS orig_bytes,
      CASE WHEN event_id % 50 <> 0 THEN 'SF' END AS conn_state
    FROM lines_base
"""


def _zeek_columns(parsed):
    names = {"ts": "ts", "id.orig_h": "orig_h", "id.resp_p": "resp_p", "orig_bytes": "orig_bytes", "conn_state": "conn_state"}
    return parsed.select("event_id", *[parse.raw_field(parsed.schema, n).alias(a) for n, a in names.items()])


@query("parse_zeek", _ZEEK_ORACLE, "lines_base")
def parse_zeek(spark, sf):
    return _zeek_columns(parse.parse_zeek(_positioned(derived.lines(spark, sf, derived.ZEEK_LINES_SQL))))


@query("parse_zeek_headers", _ZEEK_ORACLE, "lines_base")
def parse_zeek_headers(spark, sf):
    """Files whose #fields header changes, also in the middle of a block.

    Every 70th line of a file carries a new header; between them the first two
    columns stand in default or in swapped order.
    """
    rows = _positioned(derived.lines(spark, sf, derived.ZEEK_LINES_SQL))
    turn = F.floor(F.col("event_id") / 490)
    swapped = turn % 2 == 1
    names = parse.ZEEK_FIELDS
    order = ["uid", "ts", *names[2:]]
    header = F.when(swapped, "#fields\t" + "\t".join(order)).otherwise("#fields\t" + "\t".join(names))
    body = F.when(
        swapped & (F.col("event_id") % 50 != 0),
        F.regexp_replace("value", r"^([^\t]*)\t([^\t]*)", "$2\t$1"),
    ).otherwise(F.col("value"))
    first_of_turn = (F.col("event_id") % 490) < 7
    with_headers = rows.select(
        "event_id",
        "file_path",
        "block_start",
        F.explode(
            F.when(
                first_of_turn,
                F.array(
                    F.struct(header.alias("value"), (F.col("seq") - 1).alias("seq")),
                    F.struct(body.alias("value"), "seq"),
                ),
            ).otherwise(F.array(F.struct(body.alias("value"), "seq")))
        ).alias("line"),
    ).select("event_id", "file_path", "block_start", "line.value", "line.seq")
    parsed = parse.parse_zeek(with_headers).where(~F.startswith("value", F.lit("#")))
    return _zeek_columns(parsed)


@query(
    "parse_evtx",
    """
    SELECT event_id, CASE WHEN event_id % 50 <> 0 THEN CAST(4624 + event_id % 2 AS STRING) END AS EventID,
      CASE WHEN event_id % 50 <> 0 THEN iso || 'Z' END AS TimeCreated, CASE WHEN event_id % 50 <> 0 THEN src_hostname END AS Computer,
      CASE WHEN event_id % 50 <> 0 THEN user_name END AS SubjectUserName, CASE WHEN event_id % 50 <> 0 THEN src_ip END AS IpAddress
    FROM lines_base
    """,
    "lines_base",
)
def parse_evtx(spark, sf):
    parsed = parse.parse_evtx(derived.lines(spark, sf, derived.EVTX_SQL))
    fields = ["EventID", "TimeCreated", "Computer", "SubjectUserName", "IpAddress"]
    return parsed.select("event_id", *[parse.raw_field(parsed.schema, f).alias(f) for f in fields])


# -- normalised events -----------------------------------------------------------------

# Severity and activity travel in two otherwise unused Zeek columns.
_ZEEK_MAPPING = FieldMapping(
    {
        "ts": ("time", "metadata.original_time"),
        "id.orig_h": "src_endpoint.ip",
        "id.resp_p": "dst_endpoint.port",
        "orig_bytes": "network.bytes_out",
        "duration": "network.duration",
        "local_orig": "severity_id",
        "missed_bytes": "activity_id",
        "history": "file.path",
    },
    {"metadata.log_source": "zeek"},
)
_VALID = "event_id % 8 <= 6 AND event_id % 10 > 1"


@query(
    "normalize_zeek",
    f"""
    SELECT event_id, strftime(make_timestamp(seconds * 1000000), '%Y-%m-%d %H:%M:%S') AS time, CAST(2 AS INT) AS activity_id,
      CAST(event_id % 8 AS INT) AS severity_id, src_ip, dst_port, bytes_out, CAST(event_id % 9 AS DOUBLE) + 0.25 AS duration,
      concat_ws(',', CASE WHEN dst_port IN (80, 443) THEN 'T1071' END, CASE WHEN bytes_out > 10000000 THEN 'T1048' END,
        CASE WHEN dst_port > 8080 THEN 'T1090' END,
        CASE WHEN dst_port IS NOT NULL AND bytes_out = 0 THEN 'T1046' END) AS techniques
    FROM lines_base WHERE event_id % 50 <> 0 AND {_VALID}
    """,
    "lines_base",
)
def normalize_zeek(spark, sf):
    lines = derived.lines(spark, sf, derived.ZEEK_LINES_SQL)
    parsed = parse.parse_zeek(lines, fields=parse.ZEEK_FIELDS)
    events, _ = normalize.split_valid(normalize.normalize(parsed, _ZEEK_MAPPING, 3001, _AT, REGISTRY))
    return events.select(
        "event_id",
        as_text_time("time").alias("time"),
        "activity_id",
        "severity_id",
        F.col("src_endpoint.ip").alias("src_ip"),
        F.col("dst_endpoint.port").alias("dst_port"),
        F.col("network.bytes_out").alias("bytes_out"),
        F.col("network.duration").alias("duration"),
        F.coalesce(F.array_join("mitre_technique_ids", ","), F.lit("")).alias("techniques"),
    )


@query(
    "normalize_failed",
    f"SELECT event_id FROM lines_base WHERE event_id % 50 <> 0 AND NOT ({_VALID})",
    "lines_base",
)
def normalize_failed(spark, sf):
    parsed = parse.parse_zeek(derived.lines(spark, sf, derived.ZEEK_LINES_SQL), fields=parse.ZEEK_FIELDS)
    _, failed = normalize.split_valid(normalize.normalize(parsed, _ZEEK_MAPPING, 3001, _AT, REGISTRY))
    return failed.select("event_id")


@query(
    "normalize_evtx",
    "SELECT event_id, iso || 'Z' AS time, user_name, src_ip, src_hostname, auth_protocol FROM lines_base WHERE event_id % 50 <> 0",
    "lines_base",
)
def normalize_evtx(spark, sf):
    parsed = parse.parse_evtx(derived.lines(spark, sf, derived.EVTX_SQL))
    mapping = MappingRegistry.default().get("evtx", 6003)
    events, _ = normalize.split_valid(normalize.normalize(parsed, mapping, 6003, _AT, REGISTRY))
    return events.select(
        "event_id",
        F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"),
        F.col("actor.user.name").alias("user_name"),
        F.col("src_endpoint.ip").alias("src_ip"),
        F.col("src_endpoint.hostname").alias("src_hostname"),
        F.col("auth.protocol").alias("auth_protocol"),
    )


@query(
    "normalize_syslog",
    "SELECT doc_id, '2024-01-' || lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0') || ' 06:0' || CAST(doc_id % 10 AS STRING) || ':00' AS time, "
    "length(text) + 4 AS message_chars FROM documents WHERE doc_id % 50 <> 0",
)
def normalize_syslog(spark, sf):
    parsed = parse.parse_syslog(derived.written(derived.sql(spark, sf, derived.SYSLOG_LINES_SQL, "documents"), "syslog"))
    mapping = MappingRegistry.default(syslog_year=2024).get("syslog", 1001)
    events, _ = normalize.split_valid(normalize.normalize(parsed, mapping, 1001, _AT, REGISTRY))
    return events.select(
        "doc_id", as_text_time("time").alias("time"), F.length("message").cast("bigint").alias("message_chars")
    )


@query(
    "ingest_summary",
    f"""
    SELECT count(*) FILTER (event_id % 50 <> 0) AS parsed_count, count(*) FILTER (event_id % 50 = 0) AS failed_parse,
      count(*) FILTER (event_id % 50 <> 0 AND ok) AS normalised_count,
      count(*) FILTER (event_id % 50 <> 0 AND NOT ok) AS failed_normalise,
      count(*) FILTER (event_id % 50 <> 0 AND ok) AS written_count
    FROM (SELECT event_id, {_VALID} AS ok FROM flat) f
    """,
    "flat",
)
def ingest_summary(spark, sf):
    parsed = parse.parse_zeek(derived.lines(spark, sf, derived.ZEEK_LINES_SQL), fields=parse.ZEEK_FIELDS)
    return normalize.normalize(parsed, _ZEEK_MAPPING, 3001, _AT, REGISTRY).agg(*normalize.ingest_counts())


_STORED_APACHE = """
    SELECT strftime(event_time, '%Y-%m-%d %H:%M:%S') AS time, src_ip, url_path, http_code,
      CASE WHEN event_id % 17 <> 0 THEN bytes_out END AS length,
      concat_ws(',', CASE WHEN contains(CAST(http_code AS STRING), '5') THEN 'T1190' END,
        CASE WHEN contains(lower(url_path), '<script') THEN 'T1059.007' END) AS techniques
    FROM lines_base WHERE event_id % 50 <> 0
"""


def _stored_apache(events):
    return events.select(
        as_text_time("time").alias("time"),
        F.col("src_endpoint.ip").alias("src_ip"),
        F.col("http.request.url.path").alias("url_path"),
        F.col("http.response.code").alias("http_code"),
        F.col("http.response.length").alias("length"),
        F.coalesce(F.array_join("mitre_technique_ids", ","), F.lit("")).alias("techniques"),
    )


@query("ingest_store", _STORED_APACHE, "lines_base")
def ingest_store(spark, sf):
    """Lines to the event store and back."""
    store = EventStore(spark, scratch_path(spark, "ingest"), REGISTRY)
    lines = derived.lines(spark, sf, derived.APACHE_LINES_SQL)
    ingest.ingest_lines(lines, "apache", 3002, store, run_id="run-1", ingest_time=_AT)
    return _stored_apache(store.scan(3002))


@query(
    "ingest_quarantine",
    "SELECT 'garbage ' || CAST(event_id AS STRING) AS raw_line, 'parse' AS failure FROM flat WHERE event_id % 50 = 0",
    "flat",
)
def ingest_quarantine(spark, sf):
    store = EventStore(spark, scratch_path(spark, "quarantine"), REGISTRY)
    lines = derived.lines(spark, sf, derived.APACHE_LINES_SQL)
    ingest.ingest_lines(lines, "apache", 3002, store, run_id="run-1", ingest_time=_AT)
    return store.quarantine().select("raw_line", "failure")


# -- streams ---------------------------------------------------------------------------------


def event_stream(spark, sf):
    """The events table as a file stream, seen as security events."""
    schema = table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")
    flat = spark.sql(FLAT_EVENTS_SQL.replace("FROM events", "FROM {events}"), events=raw)
    return nest(flat)


@query(
    "stream_timeline",
    "SELECT strftime(to_timestamp(floor(epoch_us(event_time) / 1800000000) * 1800)::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS window_start, "
    "count(*) AS count FROM ev GROUP BY 1",
    "ev",
)
def stream_timeline(spark, sf):
    path = scratch_path(spark, "stream-timeline")
    counts = detect.stream_timeline(event_stream(spark, sf), 30)
    detect.write_latest(counts, f"{path}/changes", f"{path}/checkpoint").awaitTermination()
    latest = detect.read_latest(spark.read.parquet(f"{path}/changes"), ["window_start"])
    return latest.select(as_text_time("window_start").alias("window_start"), "count")


@query("stream_ingest", _STORED_APACHE, "lines_base")
def stream_ingest(spark, sf):
    path = scratch_path(spark, "stream-ingest")
    derived.lines(spark, sf, derived.APACHE_LINES_SQL).select("value").write.text(f"{path}/logs")
    store = EventStore(spark, f"{path}/store", REGISTRY)
    lines = stream_lines(spark, f"{path}/logs")
    start_ingest(lines, "apache", 3002, store, f"{path}/checkpoint", ingest_time=_AT).awaitTermination()
    return _stored_apache(store.scan(3002))


@query(
    "stream_ioc_hits",
    """
    SELECT event_id, concat_ws('|',
      CASE WHEN lower(src_ip) IN (SELECT ioc FROM iocs) THEN src_ip END,
      CASE WHEN lower(dst_ip) IN (SELECT ioc FROM iocs) THEN dst_ip END,
      CASE WHEN lower(file_path) IN (SELECT ioc FROM iocs) THEN file_path END,
      CASE WHEN lower(user_name) IN (SELECT ioc FROM iocs) THEN user_name END) AS matches
    FROM ev WHERE lower(src_ip) IN (SELECT ioc FROM iocs) OR lower(dst_ip) IN (SELECT ioc FROM iocs)
      OR lower(file_path) IN (SELECT ioc FROM iocs) OR lower(user_name) IN (SELECT ioc FROM iocs)
    """,
    "ev",
    "iocs",
)
def stream_ioc_hits(spark, sf):
    path = scratch_path(spark, "stream-iocs")
    hits = detect.stream_indicator_hits(event_stream(spark, sf), indicators_from_customers(spark, sf))
    (
        hits.select("event_id", F.array_join("ioc_matches", "|").alias("matches"))
        .writeStream.format("parquet")
        .option("path", f"{path}/hits")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.parquet(f"{path}/hits")


@query(
    "stream_dedup",
    "SELECT class_uid, strftime(event_time, '%Y-%m-%d %H:%M:%S.%f') AS time FROM ev GROUP BY class_uid, event_time",
    "ev",
)
def stream_dedup(spark, sf):
    path = scratch_path(spark, "stream-dedup")
    once = detect.stream_dedup(event_stream(spark, sf).unionByName(event_stream(spark, sf)))
    (
        once.select("class_uid", F.date_format("time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("time"))
        .writeStream.format("parquet")
        .option("path", f"{path}/once")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.parquet(f"{path}/once")
