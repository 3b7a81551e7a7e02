"""Mergeable moments, bucketed tables, and anomalies against running moments in a stream."""

import glob
import os
import random
from datetime import datetime, timedelta
from statistics import mean, stdev

import pytest

from tidewatch.errors import ConcurrentUpdateError
from tidewatch.operators import moments as M
from tidewatch.operators.baselines import per_event_baseline
from tidewatch.registry import MetricDefinition
from tidewatch.sources.baselines import BaselineStore, MomentStore
from tidewatch.sources.bucketed import BucketedTable, hash_bucket
from tidewatch.streaming.anomalies import stream_running_anomalies

BYTES = MetricDefinition("bytes", 3001, "ip", "src_endpoint.ip", "sum_field", "network.bytes_out")
COUNT = MetricDefinition("count", 3001, "ip", "src_endpoint.ip", "count", None)


def rows(n, days, base=1_000_000_000):
    rng = random.Random(n)
    out = []
    for i in range(n):
        at = datetime(2026, 1, 1) + timedelta(days=rng.randrange(days), seconds=rng.randrange(86400))
        value = None if i % 17 == 0 else base + rng.randrange(5)
        out.append({"class_uid": 3001, "src_endpoint.ip": f"10.0.0.{i % 7}", "network.bytes_out": value, "time": at.strftime("%Y-%m-%dT%H:%M:%SZ")})
    return out


def test_days_add_up_to_a_recomputation(make_events, spark, tmp_path):
    events = make_events(rows(600, 6))
    store = MomentStore(spark, str(tmp_path / "m"), buckets=2)
    for first, last in ((1, 3), (3, 5), (4, 5), (5, 7)):
        store.put_days(M.daily_event_moments(events.where(f"day(time) >= {first} AND day(time) < {last}"), BYTES))
    got = {r.entity_value: r for r in store.baselines().collect()}
    want = {r.entity_value: r for r in per_event_baseline(events, BYTES).collect()}
    assert got.keys() == want.keys() and len(got) == 7
    for key, w in want.items():
        g = got[key]
        assert (g.observation_count, g.window_start, g.window_end) == (w.observation_count, w.window_start, w.window_end)
        assert g.mean == pytest.approx(w.mean, rel=1e-12) and g.stddev == pytest.approx(w.stddev, rel=1e-6)


def test_few_and_no_observations(make_events):
    one = make_events([{"class_uid": 3001, "src_endpoint.ip": "a", "network.bytes_out": 5}])
    got = M.merged(M.daily_event_moments(one, BYTES), min_observations=1).first()
    assert got.mean == 5.0 and got.stddev is None and got.observation_count == 1
    assert M.merged(M.daily_event_moments(one.where("false"), BYTES)).count() == 0


def files(root):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{root}/versions/**/*.parquet", recursive=True)}


def test_an_update_leaves_other_buckets_alone(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), "k string, v int", ["k"], lambda n: hash_bucket(["k"], n), buckets=8)
    assert table.read().count() == 0
    table.upsert(spark.createDataFrame([(f"k{i}", i) for i in range(100)], "k string, v int"))
    before, versions = files(tmp_path / "t"), table.manifest()[0]
    now = table.upsert(spark.createDataFrame([("k7", 70), ("k8", 80)], "k string, v int"))
    assert {r.k: r.v for r in now.collect()} == {f"k{i}": i for i in range(100)} | {"k7": 70, "k8": 80}
    after = table.manifest()[0]
    changed = {b for b in after if after[b] != versions[b]}
    assert 1 <= len(changed) <= 2 and len(after) == 8
    assert before.items() <= files(tmp_path / "t").items()  # no file was touched
    assert table.read_bucket_of(k="k7").where("k = 'k7'").first().v == 70
    assert table.read_bucket_of(k="k7").count() < 60
    table.upsert(spark.createDataFrame([], "k string, v int"))
    assert table.manifest()[0] == after


def test_the_slower_of_two_writers_fails(spark, tmp_path, monkeypatch):
    make = lambda: BucketedTable(spark, str(tmp_path / "t"), "k string, v int", ["k"], lambda n: hash_bucket(["k"], n))
    row = lambda v: spark.createDataFrame([("a", v)], "k string, v int")
    table, other = make(), make()
    table.upsert(row(1))
    stale = other.manifest()
    table.upsert(row(2))
    monkeypatch.setattr(other, "manifest", lambda: stale)
    with pytest.raises(ConcurrentUpdateError):
        other.upsert(row(3))
    assert [r.v for r in make().read().collect()] == [2]


def test_a_day_that_is_computed_again_leaves_other_days_alone(make_events, spark, tmp_path):
    store = MomentStore(spark, str(tmp_path / "m"))
    events = make_events(rows(200, 4))
    store.put_days(M.daily_event_moments(events, BYTES))
    before = store.table.manifest()[0]
    store.put_days(M.daily_event_moments(events.where("day(time) = 2"), BYTES))
    after = store.table.manifest()[0]
    assert {b.split("-")[0] for b in after if after[b] != before[b]} == {"20260102"}


def test_lookups_read_one_bucket(make_events, spark, tmp_path):
    store = BaselineStore(spark, str(tmp_path / "b"), buckets=4)
    store.upsert(per_event_baseline(make_events(rows(400, 2)), BYTES))
    assert store.get_baseline("ip", "10.0.0.3", "bytes", 3001).observation_count > 30
    assert store.get_baseline("ip", "10.9.9.9", "bytes", 3001) is None


def test_stream_judges_hours_by_earlier_ones_and_forgets(spark, make_events, tmp_path):
    folder = tmp_path / "in"
    start = datetime(2026, 1, 1)
    counts = [3, 4, 3, 5, 4, 3, 30, 4]
    hours = [(start + timedelta(hours=h), n) for h, n in enumerate(counts)]
    hours += [(start + timedelta(days=40, hours=h), n) for h, n in enumerate([9, 9, 8, 9])]  # after a long silence

    def write(part):
        events = [{"class_uid": 3001, "src_endpoint.ip": "a", "time": (t + timedelta(minutes=m)).strftime("%Y-%m-%dT%H:%M:%SZ")} for t, n in part for m in range(n)]
        make_events(events).coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(make_events(events[:1]).schema).parquet(str(folder))
        found = stream_running_anomalies(stream, COUNT, min_observations=3, ttl_days=30)
        query = (
            found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()

    write(hours[:5])  # stopped in the middle and started again
    write(hours[5:9])
    write(hours[9:])
    got = sorted((r.hour, r.current_value, r.baseline_mean, r.baseline_stddev, r.z_score, r.is_anomaly) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = []
    for i in range(3, 8):
        past = counts[:i]
        z = (counts[i] - mean(past)) / stdev(past)
        want.append((start + timedelta(hours=i), counts[i], mean(past), stdev(past), z, abs(z) > 3))
    assert [g[0] for g in got] == [w[0] for w in want]
    for g, w in zip(got, want):
        assert g[1:5] == pytest.approx(w[1:5]) and g[5] == w[5]
    assert [w[5] for w in want] == [False, False, False, True, False]
