import ipaddress
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidewatch.errors import UnregisteredFormatError
from tidewatch.functions.coerce import parse_int, parse_time
from tidewatch.functions.ipaddr import is_ip
from tidewatch.operators import normalize as N
from tidewatch.operators import parse

AT = datetime(2026, 2, 1, tzinfo=timezone.utc)


def test_ip_syntax_agrees_with_the_standard_library(spark):
    parts = ["", "0", "1", "01", "255", "256", "a", "fe80", "12345", "::", "1.2.3.4", "1.2.3", "%eth0", "%", "g"]
    texts = set(parts)
    for left in parts:
        for right in parts:
            texts |= {left + right, f"{left}:{right}", f"{left}::{right}", f"{left}.{right}"}
    groups = ["1:" * n + "1" for n in range(1, 10)]
    texts |= set(groups) | {g + "::" for g in groups} | {"::" + g for g in groups} | {"1::" + g for g in groups}
    texts |= {"1.2.3.4\n", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::1.2.3.4:1"}

    def valid(text):
        try:
            ipaddress.ip_address(text)
            return True
        except ValueError:
            return False

    rows = spark.createDataFrame([(t,) for t in sorted(texts)], "ip string").select("ip", is_ip(F.col("ip")).alias("ok")).collect()
    assert {r.ip for r in rows if r.ok} == {t for t in texts if valid(t)}


def test_time_coercion(spark):
    cases = {
        "1609459200.0": 1609459200, "1609459200": 1609459200, "2026-01-01T00:00:00Z": 1767225600,
        "2026-01-01T00:00:00+02:00": 1767218400, "2026-01-01 00:00:00": 1767225600, "2026-01-01": 1767225600,
        "20260101T000000Z": 1767225600, "bad": None, "NaN": None, "1e300": None, "2026-13-01": None, None: None,
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", F.unix_seconds(parse_time(F.col("t"))).alias("s"))
    assert {r.t: r.s for r in rows.collect()} == cases


def test_int_coercion(spark):
    cases = {"5": 5, " 5 ": 5, "-1": -1, "1.5": None, "x": None, "true": None, "": None, None: None}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", parse_int(F.col("t")).alias("i"))
    assert {r.t: r.i for r in rows.collect()} == cases


def test_registration():
    registry = N.MappingRegistry()
    registry.register_mapping("zeek", 3001, {"ts": "time"})
    registry.register_mapping("zeek", 3002, {"ts": "time"})
    assert registry.get("zeek_conn", 3001).fields == {"ts": "time"}
    with pytest.raises(ValueError):
        registry.register_mapping("zeek_conn", 3001, {"ts": "time"})
    with pytest.raises(ValueError):
        registry.register_mapping("x", 3001, {})
    for args in ((None, 3001, {"a": "b"}), ("x", None, {"a": "b"}), ("x", 3001, None)):
        with pytest.raises(TypeError):
            registry.register_mapping(*args)
    with pytest.raises(UnregisteredFormatError):
        registry.get("apache", 3002)


FIELDS = ["ts", "id.orig_h", "id.orig_p", "id.resp_p", "orig_bytes", "act", "sev", "src", "orig", "user"]
MAPPING = N.FieldMapping(
    {
        "ts": "time", "id.orig_h": "src_endpoint.ip", "id.orig_p": "src_endpoint.port", "id.resp_p": "dst_endpoint.port",
        "orig_bytes": "network.bytes_out", "act": "activity_id", "sev": "severity_id", "src": "metadata.log_source",
        "orig": "metadata.original_time", "user": "actor.user.name", "gone": "network.protocol",
    }
)


def zeek(make_lines, *rows):
    return parse.parse_zeek(make_lines(["\t".join(r) for r in rows]), fields=FIELDS)


def test_normalize_types_tags_and_defaults(make_lines, registry):
    parsed = zeek(
        make_lines,
        ("1609459200.0", "1.1.1.1", "54321", "443", "512", "1", "1", "zeek", "o", "u"),
        ("bad", "1.1.1.1", "x", "9001", "20000000", "0", "6", "-", "-", "u"),
        ("1", "1.1.1.1", "1", "80", "0", "1.5", "1", "zeek", "o", "u"),
        ("1", "1.1.1.1", "1", "80", "0", "-1", "1", "zeek", "o", "u"),
        ("1", "1.1.1.1", "1", "80", "0", "1", "7", "zeek", "o", "u"),
        ("1", "1.1.1.1", "1", "80", "0", "1", "-", "zeek", "o", "u"),
        ("short",),
    )
    rows = N.normalize(parsed, MAPPING, 3001, AT, registry)
    events, failed = N.split_valid(rows)
    good = events.orderBy("seq").collect()
    assert [r.seq for r in good] == [0, 1] and [r.seq for r in failed.orderBy("seq").collect()] == [2, 3, 4, 5]
    first, second = good
    assert first.time == datetime(2021, 1, 1) and not first.time_fallback
    assert first.src_endpoint.port == 54321 and first.network.bytes_out == 512
    assert first.mitre_technique_ids == ["T1071"]
    assert first.actor.user.name is None  # not a field of class 3001
    assert second.time == AT.replace(tzinfo=None) and second.time_fallback
    assert second.src_endpoint.port is None
    assert second.metadata.log_source == "unknown" and second.metadata.original_time == "unknown"
    assert second.mitre_technique_ids == ["T1048", "T1090"]
    counts = rows.agg(*N.ingest_counts()).first()
    assert (counts.parsed_count, counts.failed_parse, counts.normalised_count, counts.failed_normalise) == (6, 1, 2, 4)
    assert N.dropped_fields(MAPPING, 3001, registry) == ["user"]


def test_default_mappings_cover_every_choice(make_lines, registry):
    mappings = N.MappingRegistry.default(syslog_year=2024)
    for source_format, class_uid in N.FORMAT_CHOICES.values():
        assert N.dropped_fields(mappings.get(source_format, class_uid), class_uid, registry) == []
    parsed = parse.parse_syslog(make_lines(["Feb 29 06:00:00 h p: m"]))
    row = N.normalize(parsed, mappings.get("syslog", 1001), 1001, AT, registry).first()
    assert row.time == datetime(2024, 2, 29, 6) and row.message == "m"


def test_validation_report(make_events):
    rows = [
        {"class_uid": 3001, "src_endpoint.ip": "1.2.3.4", "dst_endpoint.ip": "::1", "src_endpoint.port": 0, "dst_endpoint.port": 65535},
        {"class_uid": 3001, "src_endpoint.ip": "999.1.1.1", "dst_endpoint.ip": "abc", "src_endpoint.port": -1, "dst_endpoint.port": 65536},
        {"severity_id": 7, "metadata.log_source": None},
        {"severity_id": -1},
        {"time": None, "activity_id": None},
    ]
    got = [r.e for r in make_events(rows).orderBy("id").select(N.validation_errors().alias("e")).collect()]
    assert got[0] == []
    assert got[1] == [
        "Field 'src_endpoint.ip' value '999.1.1.1' is not a valid IPv4 or IPv6 address.",
        "Field 'dst_endpoint.ip' value 'abc' is not a valid IPv4 or IPv6 address.",
        "Field 'src_endpoint.port' value '-1' is not in range 0–65535.",
        "Field 'dst_endpoint.port' value '65536' is not in range 0–65535.",
    ]
    assert got[2] == ["Required field 'metadata.log_source' is None.", "severity_id 7 is out of range 0–6."]
    assert got[3] == ["severity_id -1 is out of range 0–6."]
    assert got[4] == ["Required field 'activity_id' is None.", "Required field 'time' is None."]


def test_retype_rows(spark, registry):
    stored = spark.createDataFrame(
        [("x", "3", "2026-01-01T00:00:00+00:00", "", "10", "f"), ("1", "9", "bad", "s", "x", "f")],
        "activity_id string, severity_id string, time string, `metadata.log_source` string, `network.bytes_out` string, `file.path` string",
    )
    rows = N.retype_rows(stored, 3001, registry).collect()
    assert len(rows) == 1
    assert rows[0].activity_id == 0 and rows[0].metadata.log_source == "unknown" and rows[0].network.bytes_out == 10
    assert rows[0].file.path is None
