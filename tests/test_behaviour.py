import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import anomalies as A
from tidewatch.operators import baselines as B
from tidewatch.operators import metrics as M
from tidewatch.operators import techniques as X
from tidewatch.operators.timeline import timeline
from tidewatch.plans import behaviour
from tidewatch.registry import MetricDefinition, MetricRegistry
from tidewatch.sources.baselines import BaselineStore

METRICS = MetricRegistry.default()
BYTES = METRICS.require("net_bytes_out_per_hour", 3001)
EXEC = METRICS.require("process_exec_count", 4001)


def net(n, ip="1.1.1.1", value=lambda i: i):
    return [
        {"class_uid": 3001, "src_endpoint.ip": ip, "network.bytes_out": value(i), "time": f"2026-01-01T{i % 24:02d}:00:00Z"}
        for i in range(n)
    ]


def test_rate_needs_two_events_and_a_span(make_events):
    rows = [
        {"actor.user.name": "a", "time": "2026-01-01T00:00:00Z"},
        {"actor.user.name": "a", "time": "2026-01-01T02:00:00Z"},
        {"actor.user.name": "one"},
        {"actor.user.name": "same"},
        {"actor.user.name": "same"},
        {"actor.user.name": None},
    ]
    got = {r.entity_value: r.value for r in M.metric_by_entity(make_events(rows), METRICS.require("auth_count_per_hour", 6003)).collect()}
    assert got == {"a": 1.0, "one": None, "same": None}


def test_sum_distinct_count(make_events):
    events = make_events(net(3) + [{"class_uid": 3001, "src_endpoint.ip": "2.2.2.2"}] + [{"class_uid": 6003, "src_endpoint.ip": "1.1.1.1"}])
    got = {(r.metric_name, r.entity_value): r.value for r in M.all_metrics(events, METRICS.get_metrics_for_class(3001)).collect()}
    assert got[("net_bytes_out_per_hour", "1.1.1.1")] == 3.0
    assert got[("net_bytes_out_per_hour", "2.2.2.2")] == 0.0
    assert got[("net_distinct_dst_ports", "2.2.2.2")] == 0.0
    assert got[("net_connection_count_per_hour", "1.1.1.1")] == 1.5
    assert M.metric_overall(events.limit(0), "net_bytes_out_per_hour", 3001).first().value is None
    with pytest.raises(ValueError):
        M.metric_overall(events, "nope", 3001)
    assert M.metric_by_entity(events, MetricDefinition("d", 3001, "ip", "src_endpoint.ip", "distinct_field_count")).first().value is None


def test_entities(make_events):
    events = make_events([{"actor.user.name": u} for u in ("b", "a", None, "b")])
    assert [r.entity_value for r in M.distinct_entities(events, "actor.user.name").collect()] == ["a", "b"]


@pytest.mark.parametrize("n, want", [(0, 0), (29, 0), (30, 1)])
def test_thirty_observations(make_events, n, want):
    events = make_events(net(n) + net(1, ip="9.9.9.9"))
    assert B.per_event_baseline(events, BYTES).count() == want


def test_per_event_values(make_events):
    row = B.per_event_baseline(make_events(net(30)), BYTES).first()
    values = list(range(30))
    mean = sum(values) / 30
    assert row["mean"] == pytest.approx(mean)
    assert row.stddev == pytest.approx(math.sqrt(sum((v - mean) ** 2 for v in values) / 29))
    assert (row.observation_count, row.window_start, row.window_end) == (30, "2026-01-01T00:00:00Z", "2026-01-01T23:00:00Z")
    events = make_events([{"class_uid": 4001, "actor.user.name": "u"}] * 30)
    assert B.per_event_baseline(events, EXEC).first().stddev == 0.0
    assert B.per_event_baseline(events, METRICS.require("child_process_spawn_rate", 4001)).count() == 0


def hourly_rows():
    rows = []
    for hour in range(60):
        for _ in range(1 + hour % 3 if hour % 4 else 0):
            rows.append({"class_uid": 4001, "actor.user.name": "u", "time": f"2026-01-{1 + hour // 24:02d}T{hour % 24:02d}:10:00Z"})
    return rows


def test_hourly_and_zero_fill_against_brute_force(make_events):
    events = make_events(hourly_rows())
    counts = {}
    for row in hourly_rows():
        counts[row["time"][:13]] = counts.get(row["time"][:13], 0) + 1
    hours = sorted(counts)[:-1]  # the newest hour is the current one
    filled = [counts[h] for h in hours]
    row = B.hourly_baseline(events, EXEC).first()
    assert (row.observation_count, row["mean"]) == (len(filled), pytest.approx(sum(filled) / len(filled)))
    grid = [f"2026-01-{1 + h // 24:02d}T{h % 24:02d}" for h in range(60)]
    span = [counts.get(h, 0) for h in grid[grid.index(hours[0]) : grid.index(hours[-1]) + 1]]
    mean = sum(span) / len(span)
    row = B.hourly_baseline(events, EXEC, zero_fill=True).first()
    assert row.observation_count == len(span) and row["mean"] == pytest.approx(mean)
    assert row.stddev == pytest.approx(math.sqrt(sum((v - mean) ** 2 for v in span) / (len(span) - 1)))
    found = behaviour.hourly_anomalies(events, EXEC).first()
    assert found.current_value == counts[max(counts)]
    assert behaviour.hourly_anomalies(events, EXEC, as_of=datetime(2026, 1, 2)).count() == 0


def test_z_score_boundaries(spark):
    base = spark.createDataFrame([("ip", "a", "m", 1, 10.0, 2.0), ("ip", "flat", "m", 1, 10.0, 0.0)],
                                 "entity_type string, entity_value string, metric_name string, class_uid int, mean double, stddev double")
    values = [("a", 16.0), ("a", 16.01), ("a", 4.0), ("a", 3.9), ("flat", 10.0), ("flat", 11.0), ("none", 1.0),
              ("a", float("nan")), ("a", float("inf")), ("a", float("-inf")), ("a", None)]
    current = spark.createDataFrame([("ip", e, "m", 1, v) for e, v in values],
                                    "entity_type string, entity_value string, metric_name string, class_uid int, current_value double")
    got = {(r.entity_value, r.current_value): (r.z_score, r.is_anomaly) for r in A.detect_anomalies(current, base).collect()}
    assert got[("a", 16.0)] == (3.0, False) and got[("a", 16.01)][1] and got[("a", 4.0)] == (-3.0, False) and got[("a", 3.9)][1]
    assert got[("flat", 10.0)] == (0.0, False) and got[("flat", 11.0)] == (4.0, True)
    assert len(got) == 6
    shown = A.display_anomalies(A.detect_anomalies(current, base)).where("current_value = 11").first()
    assert shown.entity == "ip=flat" and shown.is_anomaly
    text = A.detect_anomalies(current, base).where("current_value = 11").select(A.anomaly_message().alias("m")).first().m
    assert text == ("[LLM unavailable] Anomaly detected: m for ip=flat deviated 4.00 standard deviations from the "
                    "baseline mean of 10.0000 (current value: 11.0000).")


def test_baseline_store(spark, make_events, tmp_path):
    store = BaselineStore(spark, str(tmp_path / "b"))
    assert store.read().count() == 0 and store.get_baseline("ip", "1.1.1.1", BYTES.metric_name, 3001) is None
    store.upsert(B.per_event_baseline(make_events(net(30) + net(30, "2.2.2.2")), BYTES))
    store.upsert(B.per_event_baseline(make_events(net(40, "2.2.2.2") + net(30, "3.3.3.3")), BYTES))
    got = {r.entity_value: r.observation_count for r in store.read().collect()}
    assert got == {"1.1.1.1": 30, "2.2.2.2": 40, "3.3.3.3": 30}
    assert store.get_baseline("ip", "2.2.2.2", BYTES.metric_name, 3001).observation_count == 40
    with pytest.raises(TypeError):
        store.get_baseline("ip", None, "m", 1)


def test_timeline(make_events, spark):
    events = make_events([{"time": t} for t in ("2026-01-01T00:06:59Z", "2026-01-01T00:07:00Z", "2026-01-01T23:59:00Z", "2026-01-02T00:00:00Z", None)])
    got = [(r.timestamp, r["count"]) for r in timeline(events, 7).collect()]
    assert got == [("2026-01-01 00:00", 1), ("2026-01-01 00:07", 1), ("2026-01-01 23:55", 1), ("2026-01-02 00:00", 1)]
    text = spark.createDataFrame([("2026-01-01T00:00:00",), ("not-a-date",), (None,)], "time string")
    assert [(r.timestamp, r["count"]) for r in timeline(text).collect()] == [("2026-01-01 00:00", 1)]
    with pytest.raises(ValueError):
        timeline(events, 0)


def test_tags(make_events):
    rows = [
        ({"activity_id": 1, "severity_id": 1, "actor.user.name": "CORP\\a"}, ["T1078", "T1078.002"]),
        ({"activity_id": 2, "severity_id": 3, "auth.protocol": "NTLMv2"}, ["T1110", "T1110.001"]),
        ({"class_uid": 4001, "actor.process.name": "PowerShell.exe"}, ["T1059", "T1059.001"]),
        ({"class_uid": 4001, "actor.process.name": "svchost.exe"}, None),
        ({"class_uid": 4001, "actor.process.name": "svchost.exe", "process.name": "x"}, ["T1055"]),
        ({"class_uid": 4001, "actor.process.name": "cat.exe"}, ["T1053"]),
        ({"class_uid": 3001, "dst_endpoint.port": 443, "network.bytes_out": 0}, ["T1071", "T1046"]),
        ({"class_uid": 3001, "dst_endpoint.port": 8081, "network.bytes_out": 10_000_001}, ["T1048", "T1090"]),
        ({"class_uid": 3001, "dst_endpoint.port": 8080, "network.bytes_out": 10_000_000}, None),
        ({"class_uid": 3002, "http.response.code": 205, "http.request.url.path": "/<SCRIPT>"}, ["T1190", "T1059.007"]),
        ({"class_uid": 1001, "activity_id": 4, "file.path": "C:\\Windows\\System32\\x"}, ["T1005", "T1070.004"]),
        ({"class_uid": 1001, "activity_id": None}, None),
    ]
    tagged = X.tag_events(make_events([r for r, _ in rows])).orderBy("id")
    assert [r.mitre_technique_ids for r in tagged.collect()] == [want for _, want in rows]
    counts = {r.technique_id: r.events for r in X.count_techniques(tagged).collect()}
    assert counts["T1059"] == 1 and sum(counts.values()) == sum(len(w or []) for _, w in rows)
    only = X.tag_events(tagged.where("class_uid = 3001"), class_uid=3001)
    assert only.where("mitre_technique_ids IS NOT NULL").count() == 2


def test_own_rule_as_column(make_events, spark):
    mine = X.TechniqueRule("T9", 6003, lambda: F.col("status") == "ok")
    tagged = X.tag_events(make_events([{"status": "ok"}, {"status": None}]), [mine]).orderBy("id").collect()
    assert [r.mitre_technique_ids for r in tagged] == [["T9"], None]
    per_class = {r.class_uid: r.technique_ids for r in X.techniques_by_class(spark, [mine]).collect()}
    assert per_class[6003] == ["T9"] and per_class[1001] == [] and len(per_class) == 5
    assert len(X.rules_for_class(4001)) == 4
