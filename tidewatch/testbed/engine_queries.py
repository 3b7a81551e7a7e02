"""Queries through the engine's own readers, stores and jobs, over files that Spark writes from the test tables."""

from __future__ import annotations

import atexit
import json
import os
import tempfile
from dataclasses import asdict, replace
from datetime import datetime, timezone

from pyspark.sql import functions as F

from tidewatch.operators import events as event_ops
from tidewatch.operators import indicators, metrics, parse, rules, techniques
from tidewatch.operators.normalize import MappingRegistry
from tidewatch.plans.ingest import ingest_lines
from tidewatch.plans.investigate import event_query, run_event_query
from tidewatch.registry import FieldRegistry, MetricRegistry
from tidewatch.session import scratch_path, settled
from tidewatch.sources import indicators as indicator_source
from tidewatch.sources.audit import AuditLog
from tidewatch.sources.lines import read_lines
from tidewatch.sources.store import EventStore
from tidewatch.streaming import detect
from tidewatch.streaming.anomalies import stream_running_anomalies
from tidewatch.streaming.ingest import start_ingest, stream_lines
from tidewatch.testbed import derived
from tidewatch.testbed.adapter import FLAT_EVENTS_SQL, REGISTRY, nest, security_events, table
from tidewatch.testbed.catalog import ORACLES, query
from tidewatch.testbed.derived import as_text_time
from tidewatch.testbed.detection_queries import _EVENT_TEXT, _HITS, _rules
from tidewatch.testbed.event_queries import PROCESS_COUNT, _with_hours
from tidewatch.testbed.ingest_queries import event_stream

_AT = datetime(2026, 1, 1, tzinfo=timezone.utc)
_RANGE = (datetime(2024, 1, 5, 6, tzinfo=timezone.utc), datetime(2024, 1, 9, 18, tzinfo=timezone.utc))


@query(
    "parse_zeek_files",
    """
    SELECT 'C' || CAST(event_id AS STRING) AS uid, src_ip, CAST(dst_port AS STRING) AS dst_port FROM lines_base WHERE event_id % 50 <> 0
    """,
    "lines_base",
)
def parse_zeek_files(spark, sf):
    """Real files whose column order changes every few hundred lines, within the file."""
    names = parse.ZEEK_FIELDS
    turn = F.floor(F.col("event_id") / 300)
    swapped = turn % 2 == 1
    lines = derived.sql(spark, sf, derived.ZEEK_LINES_SQL, "flat", "lines_base")
    body = F.when(swapped & (F.col("event_id") % 50 != 0), F.regexp_replace("value", r"^([^\t]*)\t([^\t]*)", "$2\t$1"))
    header = F.when(swapped, "#fields\t" + "\t".join(["uid", "ts", *names[2:]])).otherwise("#fields\t" + "\t".join(names))
    # One text of several lines for each turn of 300 events.
    turns = lines.select(turn.alias("turn"), "event_id", F.coalesce(body, "value").alias("line"), header.alias("header")).groupBy("turn", "header").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"]), "\n").alias("lines")
    )
    path = scratch_path(spark, "zeek-files")
    turns.select(F.concat_ws("\n", "header", "lines")).write.text(path)
    parsed = parse.parse_zeek(read_lines(spark, path)).where("is_parsed")
    field = lambda name: parse.raw_field(parsed.schema, name)
    return parsed.select(field("uid").alias("uid"), field("id.orig_h").alias("src_ip"), field("id.resp_p").alias("dst_port"))


def _streamed_evtx(spark, sf):
    path = scratch_path(spark, "stream-evtx")
    records = derived.sql(spark, sf, derived.EVTX_SQL, "flat", "lines_base")
    records.select(F.regexp_replace("value", "><", ">\n  <").alias("value")).write.text(f"{path}/logs")
    store = EventStore(spark, f"{path}/store", REGISTRY)
    lines = stream_lines(spark, f"{path}/logs", source_format="evtx")
    start_ingest(lines, "evtx", 6003, store, f"{path}/checkpoint", ingest_time=_AT).awaitTermination()
    return store


@query(
    "stream_ingest_evtx_quarantine",
    "SELECT '<broken garbage ' || CAST(event_id AS STRING) AS raw_line, 'parse' AS failure FROM flat WHERE event_id % 50 = 0",
    "flat",
)
def stream_ingest_evtx_quarantine(spark, sf):
    """The malformed records of the same stream."""
    return _streamed_evtx(spark, sf).quarantine().select(F.trim("raw_line").alias("raw_line"), "failure")


@query(
    "stream_ingest_evtx",
    "SELECT replace(iso, 'T', ' ') AS time, user_name, src_ip, src_hostname, auth_protocol FROM lines_base WHERE event_id % 50 <> 0",
    "lines_base",
)
def stream_ingest_evtx(spark, sf):
    """Records over several lines, between malformed ones, from files as they arrive."""
    return _streamed_evtx(spark, sf).scan(6003).select(
        as_text_time("time").alias("time"),
        F.col("actor.user.name").alias("user_name"),
        F.col("src_endpoint.ip").alias("src_ip"),
        F.col("src_endpoint.hostname").alias("src_hostname"),
        F.col("auth.protocol").alias("auth_protocol"),
    )


def _filled_store(spark, sf, label):
    path = scratch_path(spark, label)
    store = EventStore(spark, f"{path}/events", REGISTRY, AuditLog(spark, f"{path}/audit"))
    store.append(techniques.tag_events(security_events(spark, sf)), "testbed", run_id="base")
    return store


@query(
    "store_time_range",
    "SELECT user_name, count(*) AS events FROM ev WHERE class_uid = 3002 AND http_code = 500 "
    "AND event_time BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-09 18:00:00' GROUP BY user_name",
    "ev",
)
def store_time_range(spark, sf):
    """The audited event query: a time range opens only the folders of its days."""
    store = _filled_store(spark, sf, "time-range")
    found = run_event_query(store, lambda rows: settled(rows, "found"), 3002, {"http.response.code": 500}, _RANGE)
    return found.groupBy(F.col("actor.user.name").alias("user_name")).agg(F.count(F.lit(1)).alias("events"))


@query(
    "store_needle",
    "SELECT strftime(event_time, '%Y-%m-%d %H:%M:%S') AS time, dst_ip, bytes_out FROM ev WHERE class_uid = 3001 AND src_ip = '10.0.0.17'",
    "ev",
)
def store_needle(spark, sf):
    """A single value, in a store whose files are sorted by the field and have Bloom filters of it."""
    found = event_query(_filled_store(spark, sf, "needle"), 3001, {"src_endpoint.ip": "10.0.0.17"})
    return found.select(as_text_time("time").alias("time"), F.col("dst_endpoint.ip").alias("dst_ip"), F.col("network.bytes_out").alias("bytes_out"))


@query(
    "event_query_audit",
    "SELECT CAST(3002 AS INT) AS event_class, true AS success, count(*) AS row_count FROM ev WHERE class_uid = 3002 AND http_code = 500 "
    "AND event_time BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-09 18:00:00'",
    "ev",
)
def event_query_audit(spark, sf):
    """What the audit trail has of such a query."""
    store = _filled_store(spark, sf, "query-audit")
    run_event_query(store, lambda rows: settled(rows, "found"), 3002, {"http.response.code": 500}, _RANGE)
    return store.audit.query_history().select("event_class", "success", "row_count")


@query("store_partitions", "SELECT class_uid, count(*) AS events FROM ev GROUP BY class_uid", "ev")
def store_partitions(spark, sf):
    """Stored classes as the store lists them, each with its rows."""
    store = _filled_store(spark, sf, "partitions")
    listed = spark.createDataFrame([(c,) for c in store.available_partitions()], "class_uid int")
    counts = store.scan_all().groupBy("class_uid").agg(F.count(F.lit(1)).alias("events"))
    return listed.join(counts, "class_uid")


@query("ioc_hits_files", f"SELECT event_id, matches FROM ({_HITS}) h WHERE matches <> ''", "ev", "iocs")
def ioc_hits_files(spark, sf):
    """Indicators read from files."""
    path = scratch_path(spark, "indicator-files")
    derived.indicator_lines(spark, sf).select("value").write.text(path)
    listed = indicator_source.distinct_indicators(indicator_source.read_indicators(spark, path))
    found = indicators.indicator_hits(security_events(spark, sf), listed)
    return found.select("event_id", F.array_join("ioc_matches", "|").alias("matches"))


# An indicator for each line item, most of which no event has; the bound is set below its size.
_MANY_IOCS_SQL = """
SELECT DISTINCT '10.0.0.' || CAST(l_orderkey AS STRING) AS ioc FROM lineitem
UNION SELECT 'user' || CAST(l_partkey AS STRING) || '-' || CAST(l_linenumber AS STRING) FROM lineitem
UNION SELECT '192.168.1.' || CAST(l_suppkey * 7 AS STRING) FROM lineitem
"""
_MANY_BYTES = 16 * 1024
_MANY_HITS = _HITS.replace("iocs", "many_iocs")


@query("ioc_hits_large_list", f", many_iocs AS ({_MANY_IOCS_SQL}) SELECT event_id, matches FROM ({_MANY_HITS}) h WHERE matches <> ''", "ev")
def ioc_hits_large_list(spark, sf):
    listed = derived.sql(spark, sf, _MANY_IOCS_SQL, "lineitem")
    found = indicators.indicator_hits(security_events(spark, sf), listed, max_bytes=_MANY_BYTES)
    return found.select("event_id", F.array_join("ioc_matches", "|").alias("matches"))


@query("ioc_marks_large_list", f", many_iocs AS ({_MANY_IOCS_SQL}) SELECT event_id, matches FROM ({_MANY_HITS}) h", "ev")
def ioc_marks_large_list(spark, sf):
    """All events with their matches, those without any included."""
    listed = derived.sql(spark, sf, _MANY_IOCS_SQL, "lineitem")
    found = indicators.mark_indicators(security_events(spark, sf), listed, max_bytes=_MANY_BYTES)
    return found.select("event_id", F.array_join("ioc_matches", "|").alias("matches"))


@query("stream_ioc_hits_large_list", f", many_iocs AS ({_MANY_IOCS_SQL}) SELECT event_id, matches FROM ({_MANY_HITS}) h WHERE matches <> ''", "ev")
def stream_ioc_hits_large_list(spark, sf):
    path = scratch_path(spark, "stream-many-iocs")
    listed = derived.sql(spark, sf, _MANY_IOCS_SQL, "lineitem")
    hits = detect.stream_indicator_hits(event_stream(spark, sf), listed, max_bytes=_MANY_BYTES)
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


def _backtest(name: str, **search):
    def build(spark, sf):
        return rules.backtest_rules(security_events(spark, sf), _rules(spark, sf), skip=("event_id",), **search)

    query(name, ORACLES["backtest_counts"])(build)


# The same as backtest_counts, with the search for large sets.
_backtest("backtest_counts_multi", literal_keywords=8)
_backtest("backtest_counts_join", literal_keywords=0)


# Two keywords for each line item, all with one prefix; some occur in events of low addresses.
_PREFIX_KEYWORDS_SQL = """
SELECT '10.0.0.' || CAST(l_orderkey AS STRING) || ' host' || CAST(l_linenumber AS STRING) AS keyword FROM lineitem
UNION SELECT '10.0.0.' || CAST(l_orderkey AS STRING) || '.' || CAST(l_linenumber AS STRING) FROM lineitem
"""


@query(
    "keyword_hits_shared_prefix",
    f"""
    , words AS ({_PREFIX_KEYWORDS_SQL}),
    texts AS (SELECT src_ip, {_EVENT_TEXT} AS text FROM ev)
    SELECT keyword, count(*) AS events FROM words JOIN texts ON src_ip = split_part(keyword, ' ', 1) AND contains(text, keyword) GROUP BY keyword
    """,
    "ev",
)
def keyword_hits_shared_prefix(spark, sf):
    """Events by keyword, for 100,000 keywords and more (at sf0.01) that share their first characters."""
    words = derived.sql(spark, sf, _PREFIX_KEYWORDS_SQL, "lineitem")
    texts = security_events(spark, sf)
    texts = texts.select(rules.event_text(texts, skip=("event_id",)).alias("text"))
    sets = rules.keyword_sets(texts, words)
    return sets.select(F.explode("hits").alias("keyword"), "n").groupBy("keyword").agg(F.sum("n").alias("events"))


@query(
    "stream_anomalies",
    _with_hours(
        """
        , judged AS (
          SELECT hour, entity_value, value, avg(value) OVER w AS mean, stddev_samp(value) OVER w AS sd, count(*) OVER w AS n
          FROM hours WINDOW w AS (PARTITION BY entity_value ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        scored AS (SELECT *, CASE WHEN sd <> 0 THEN (value - mean) / sd WHEN value = mean THEN 0.0 ELSE 4.0 END AS z FROM judged)
        SELECT strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, entity_value, value AS current_value, round(mean, 3) AS baseline_mean,
          n AS observation_count, round(z, 3) AS z_score, abs(z) > 3.0 AS is_anomaly
        FROM scored WHERE n >= 5 AND hour + INTERVAL 1 HOUR <= (SELECT max(last_time) - INTERVAL 10 MINUTE FROM hours)
        """
    ),
)
def stream_anomalies(spark, sf):
    """Hours judged by each entity's earlier hours, by a stream that is stopped half-way and started again."""
    path = scratch_path(spark, "stream-anomalies")
    raw = table(spark, sf, "events")
    cut = F.lit("2024-01-16 12:30:00").cast("timestamp_ntz")
    for part in (raw.where(F.col("ts") < cut), raw.where(F.col("ts") >= cut)):
        part.write.mode("append").parquet(f"{path}/events")
        stream = spark.readStream.schema(raw.schema).parquet(f"{path}/events")
        events = nest(spark.sql(FLAT_EVENTS_SQL.replace("FROM events", "FROM {events}"), events=stream))
        (
            stream_running_anomalies(events, PROCESS_COUNT, min_observations=5)
            .writeStream.format("parquet")
            .option("path", f"{path}/judged")
            .option("checkpointLocation", f"{path}/checkpoint")
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )
    return spark.read.parquet(f"{path}/judged").select(
        as_text_time("hour").alias("hour"),
        "entity_value",
        "current_value",
        F.round("baseline_mean", 3).alias("baseline_mean"),
        "observation_count",
        F.round("z_score", 3).alias("z_score"),
        "is_anomaly",
    )


_PLAIN = r"[^\x20-\x7e\x{a1}-\x{ff}]"


@query(
    "read_latin1_files",
    f"""
    SELECT CAST(doc_id AS STRING) AS doc_id, sha256(CAST(doc_id AS STRING) || ' ' || regexp_replace(coalesce(text, ''), '{_PLAIN}', ' ', 'g') || ' .') AS line_sha256
    FROM documents
    """,
)
def read_latin1_files(spark, sf):
    """One folder with files in UTF-8 and files in latin-1: each is read in its own encoding."""
    docs = table(spark, sf, "documents")
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), _PLAIN, " ")
    lines = docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(" "), plain, F.lit(" .")).alias("value"), (F.col("lang") == "en").alias("en"))
    path = scratch_path(spark, "encodings")
    english = F.coalesce("en", F.lit(True))
    # As many files as the table has splits, so no task writes more than one of them.
    lines.where(english).select("value").write.text(f"{path}/utf8")
    latin = lines.where(~english).select("value")
    raw = {"encoding": "ISO-8859-1", "sep": "\x01", "quote": "\x00", "escape": "\x00", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    latin.write.options(**raw).csv(f"{path}/latin1")
    read = read_lines(spark, [f"{path}/utf8", f"{path}/latin1"])
    return read.select(F.split_part("value", F.lit(" "), F.lit(1)).alias("doc_id"), F.sha2("value", 256).alias("line_sha256"))


@query(
    "ingest_audit_trail",
    """
    SELECT 'query' AS kind, 'DROPPED_FIELDS:user' AS text, CAST(3002 AS INT) AS class_uid, CAST(NULL AS BIGINT) AS events, false AS success
    UNION ALL SELECT 'ingest', 'apache', 3002, count(*), true FROM flat WHERE event_id % 50 <> 0
    """,
    "flat",
)
def ingest_audit_trail(spark, sf):
    """What an ingest leaves in the audit: the fields its mapping names but the class does not have, and the run itself."""
    path = scratch_path(spark, "ingest-audit")
    audit = AuditLog(spark, f"{path}/audit")
    store = EventStore(spark, f"{path}/events", REGISTRY, audit)
    known = MappingRegistry.default().get("apache", 3002)
    mappings = MappingRegistry()
    mappings.register_mapping("apache", 3002, replace(known, fields={**known.fields, "user": "process.name"}))
    ingest_lines(derived.lines(spark, sf, derived.APACHE_LINES_SQL), "apache", 3002, store, mappings, run_id="run-1", ingest_time=_AT)
    asked = audit.query_history().select(
        F.lit("query").alias("kind"), F.col("sql_template").alias("text"), F.col("event_class").alias("class_uid"), F.lit(None).cast("bigint").alias("events"), "success"
    )
    run = audit.ingest_history().select(
        F.lit("ingest").alias("kind"), F.col("source_format").alias("text"), "class_uid", F.col("event_count").alias("events"), F.lit(True).alias("success")
    )
    return asked.unionByName(run)


def _document(list_key: str, definitions) -> str:
    """A registry document in a file of the driver, which alone reads it."""
    with tempfile.NamedTemporaryFile("w", suffix=".json", delete=False) as out:
        json.dump({"version": "1.0", list_key: [asdict(d) for d in definitions]}, out)
    atexit.register(os.unlink, out.name)
    return out.name


@query("metrics_from_json", ORACLES["metrics_all"])
def metrics_from_json(spark, sf):
    """All metrics as a document declares them."""
    loaded = MetricRegistry.from_json(_document("metrics", MetricRegistry.default().all()))
    return metrics.all_metrics(security_events(spark, sf), loaded.all()).withColumn("value", F.round("value", 4))


@query(
    "class_fields_from_json",
    "SELECT strftime(event_time, '%Y-%m-%d %H:%M:%S') AS time, src_ip, dst_ip, dst_port, bytes_out FROM ev WHERE class_uid = 3001",
    "ev",
)
def class_fields_from_json(spark, sf):
    """The fields of a class as a document declares them, one of which it takes from the class."""
    definitions = [REGISTRY.get_field_definition(p) for p in REGISTRY.paths]
    without = [replace(d, applicable_classes=tuple(c for c in d.applicable_classes if c != 3001)) if d.field_path == "network.bytes_in" else d for d in definitions]
    loaded = FieldRegistry.from_json(_document("fields", without))
    flat = event_ops.class_projection(security_events(spark, sf), 3001, loaded)
    if "network.bytes_in" in flat.columns or set(loaded.paths) != set(REGISTRY.paths):
        raise ValueError("the document was not read as it was written")
    names = {"src_endpoint.ip": "src_ip", "dst_endpoint.ip": "dst_ip", "dst_endpoint.port": "dst_port", "network.bytes_out": "bytes_out"}
    return flat.select(as_text_time("time").alias("time"), *[F.col(f"`{path}`").alias(name) for path, name in names.items()])
