import os
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidewatch.operators.baselines import per_event_baseline
from tidewatch.registry import MetricDefinition
from tidewatch.sources.store import EventStore
from tidewatch.streaming import detect
from tidewatch.streaming.ingest import start_ingest, stream_lines

APACHE = '10.0.0.1 - u [01/Jan/2026:00:00:0{0} +0000] "GET /{0} HTTP/1.1" 200 1'
AT = datetime(2026, 1, 1, tzinfo=timezone.utc)


def run(df, tmp_path, mode="append"):
    query = (
        df.writeStream.format("parquet").outputMode(mode).option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(str(tmp_path / "out"))


@pytest.fixture
def feed(spark, make_events, tmp_path):
    """Write event batches as files, read back as a stream one file at a time."""
    folder = tmp_path / "feed"
    seen = set()

    def build(*batches):
        for i, rows in enumerate(batches):
            make_events(rows).coalesce(1).write.mode("append").parquet(str(folder))
            for file in folder.glob("part-*.parquet"):  # files are taken in order of their time
                if file.name not in seen:
                    seen.add(file.name)
                    os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))
        schema = make_events(batches[0]).schema
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))

    return build


def test_ingest_resumes_and_repeats_without_copies(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    store = EventStore(spark, str(tmp_path / "store"))

    def once(checkpoint):
        lines = stream_lines(spark, str(logs), max_files_per_trigger=1)
        start_ingest(lines, "apache", 3002, store, str(tmp_path / checkpoint), ingest_time=AT).awaitTermination()

    (logs / "a.log").write_text(APACHE.format(1) + "\nbad\n")
    once("cp")
    (logs / "b.log").write_text(APACHE.format(2) + "\n")
    once("cp")
    assert sorted(r.http.request.url.path for r in store.scan(3002).collect()) == ["/1", "/2"]
    assert store.quarantine().count() == 1
    once("lost-checkpoint")  # everything is read again under the same batch names
    assert store.scan(3002).count() == 2


def test_timeline_drops_late_rows(feed, tmp_path, spark):
    stream = feed(
        [{"time": "2026-01-01T00:05:00Z"}, {"time": "2026-01-01T02:00:00Z"}],
        [{"time": "2026-01-01T02:10:00Z"}],
        [{"time": "2026-01-01T00:10:00Z"}, {"time": "2026-01-01T02:30:00Z"}],  # the first one is late
    )
    out, checkpoint = str(tmp_path / "changes"), str(tmp_path / "cp")
    detect.write_latest(detect.stream_timeline(stream, 60), out, checkpoint).awaitTermination()
    latest = detect.read_latest(spark.read.parquet(out), ["window_start"]).collect()
    assert {r.window_start.hour: r["count"] for r in latest} == {0: 1, 2: 3}
    with pytest.raises(ValueError):
        detect.stream_timeline(stream, 7)


def test_indicator_hits(feed, tmp_path, spark):
    stream = feed([{"actor.user.name": "Eve"}, {"actor.user.name": "bob"}], [{"src_endpoint.ip": "1.1.1.1"}])
    iocs = spark.createDataFrame([("eve",), ("1.1.1.1",)], "ioc string")
    hits = detect.stream_indicator_hits(stream, iocs).select(F.array_join("ioc_matches", ",").alias("m"))
    assert sorted(r.m for r in run(hits, tmp_path).collect()) == ["1.1.1.1", "Eve"]


def test_dedup(feed, tmp_path):
    row = {"metadata.original_time": "x"}
    stream = feed([row, row, {"metadata.original_time": "y"}], [row])
    assert run(detect.stream_dedup(stream).select("metadata.original_time"), tmp_path).count() == 2


def test_anomalies_when_the_hour_closes(feed, make_events, tmp_path):
    metric = MetricDefinition("bytes", 3001, "ip", "src_endpoint.ip", "sum_field", "network.bytes_out")

    def row(time, value):
        return {"class_uid": 3001, "src_endpoint.ip": "1.1.1.1", "network.bytes_out": value, "time": time}

    baselines = per_event_baseline(make_events([row("2026-01-01T00:00:00Z", i % 3) for i in range(30)]), metric)
    stream = feed(
        [row("2026-01-02T00:05:00Z", 500), row("2026-01-02T00:06:00Z", 500)],
        [row("2026-01-02T03:00:00Z", 1)],
    )
    rows = run(detect.stream_anomalies(stream, metric, baselines), tmp_path).collect()
    assert [(r.current_value, r.is_anomaly, r.hour.hour) for r in rows] == [(1000.0, True, 0)]


def test_large_indicator_list_over_restarts(feed, tmp_path, spark):
    rows = [{"actor.user.name": f"Eve{i}", "src_endpoint.ip": f"1.1.1.{i}"} for i in range(60)]
    iocs = spark.range(500).select(F.concat(F.lit("eve"), F.col("id") * 7).alias("ioc"))
    stream = feed(rows[:30], rows[30:])
    hits = detect.stream_indicator_hits(stream, iocs, max_bytes=100).select(F.array_join("ioc_matches", ",").alias("m"))
    first = hits.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()
    first.awaitTermination()
    again = detect.stream_indicator_hits(feed(rows[:30]), iocs, max_bytes=100).select(F.array_join("ioc_matches", ",").alias("m"))
    assert sorted(r.m for r in run(again, tmp_path).collect()) == sorted([f"Eve{i}" for i in range(0, 60, 7)] + [f"Eve{i}" for i in range(0, 30, 7)])
