import pytest
from pyspark.sql import functions as F

from tidewatch.errors import PartitionNotFoundError, ReplaySessionNotFoundError
from tidewatch.operators import indicators as I
from tidewatch.plans.ingest import failure_summary, ingest_files, ingest_lines
from tidewatch.plans.investigate import event_query, run_event_query, run_spec
from tidewatch.operators.filters import FieldFilter, QuerySpec
from tidewatch.sources import indicators as S
from tidewatch.sources.audit import AuditLog
from tidewatch.sources.lines import read_lines, read_xml_records
from tidewatch.sources.store import EventStore

APACHE = '10.0.0.1 - u [01/Jan/2026:00:00:0{0} +0000] "GET /{0} HTTP/1.1" 200 1'


def test_lines_encoding_blanks_and_line_ends(spark, tmp_path):
    (tmp_path / "a.log").write_bytes("grüße\n\n   \nx\u2028y\r\nz\x0bw".encode())
    (tmp_path / "b.log").write_bytes("caf\xe9\nplain".encode("latin-1"))
    got = sorted(r.value for r in read_lines(spark, str(tmp_path)).collect())
    assert got == sorted(["grüße", "x", "y", "z", "w", "café", "plain"])
    assert {r.value for r in read_lines(spark, str(tmp_path / "b.log"), "line").collect()} == {"café", "plain"}
    with pytest.raises(ValueError):
        read_lines(spark, str(tmp_path), "ebcdic")


def test_xml_records_over_several_lines(spark, tmp_path):
    (tmp_path / "e.xml").write_text('<?xml version="1.0"?>\n<Events>\n<Event xmlns="n">\n <A/>\n</Event>\n<Event><B/></Event>\n</Events>\n')
    got = [r.value for r in read_xml_records(spark, str(tmp_path)).orderBy("seq").collect()]
    assert got == ['<Event xmlns="n">\n <A/>\n</Event>', "<Event><B/></Event>"]


def test_text_between_xml_records_is_kept_as_records(spark, tmp_path):
    (tmp_path / "e.xml").write_text(
        '<?xml version="1.0"?><Events>\n<broken one\n<Event><A/></Event>\n\n two \r\n<broken three>\n<Event xmlns="n">\n<B/></Event></Events>\nlast\n<Event a='
    )
    got = [r.value for r in read_xml_records(spark, str(tmp_path)).orderBy("seq").collect()]
    assert [v.strip() for v in got if not v.startswith("<Event")] == ["<broken one", "two", "<broken three>", "</Events>", "last"][:3] + ["last"]
    assert [v for v in got if v.startswith("<Event")][:2] == ["<Event><A/></Event>", '<Event xmlns="n">\n<B/></Event>']


def test_indicator_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# comment\n\n 10.0.0.7 \nEVIL.exe\n10.0.0.7\nlast\n")
    (tmp_path / "b.txt").write_text("10.0.0.7\nother\n")
    rows = S.read_indicators(spark, str(tmp_path), cap=3)
    assert sorted(r.loaded for r in S.loaded_per_file(rows).collect()) == [2, 3]
    assert {r.ioc for r in S.distinct_indicators(rows).collect()} == {"10.0.0.7", "evil.exe", "other"}
    assert S.count_indicators(rows).first().ioc_count == 3


def test_cap_counts_over_blocks(spark):
    rows = [(f"v{b}-{i}", "f", b, i) for b in range(4) for i in range(10)]
    lines = spark.createDataFrame(rows, "value string, file_path string, block_start bigint, seq bigint")
    got = {r.ioc for r in S.indicator_rows(lines, cap=15).collect()}
    assert got == {f"v0-{i}" for i in range(10)} | {f"v1-{i}" for i in range(5)}


@pytest.mark.parametrize("max_bytes", [0, I.BROADCAST_BYTES])
def test_indicator_match_keeps_order_and_original_text(spark, make_events, max_bytes):
    events = make_events(
        [
            {"class_uid": 3001, "src_endpoint.ip": "10.0.0.7", "dst_endpoint.ip": "10.0.0.7"},
            {"class_uid": 1001, "file.path": "/Etc/Passwd"},
            {"actor.user.name": "User3", "src_endpoint.ip": "1.1.1.1"},
            {"actor.user.name": None},
        ]
    )
    iocs = spark.createDataFrame([("10.0.0.7",), ("/etc/passwd",), ("user3",), ("10.0.0.7",)], "ioc string")
    marked = {r.id: r.ioc_matches for r in I.mark_indicators(events, iocs, max_bytes).collect()}
    assert marked == {0: ["10.0.0.7", "10.0.0.7"], 1: ["/Etc/Passwd"], 2: ["User3"], 3: []}
    assert I.clean_events(events, iocs, max_bytes).count() == 1
    assert I.mark_indicators(events, iocs.limit(0), max_bytes).where(F.size("ioc_matches") > 0).count() == 0


@pytest.fixture
def store(spark, tmp_path):
    return EventStore(spark, str(tmp_path / "store"), audit=AuditLog(spark, str(tmp_path / "audit")))


def test_append_scan_and_partitions(store, make_events, tmp_path):
    assert store.available_partitions() == []
    with pytest.raises(PartitionNotFoundError):
        store.scan(3001)
    with pytest.raises(PartitionNotFoundError):
        store.scan_all()
    events = make_events([{"class_uid": 3001, "network.bytes_out": 5}, {"class_uid": 6003}, {"class_uid": 6003}])
    assert store.append(events, "zeek") == 3
    assert store.append(events.where("class_uid = 6003"), "zeek", compact=True) == 2
    (tmp_path / "store" / "table=events" / "class_uid=oops").mkdir()
    assert store.available_partitions() == [3001, 6003]
    assert store.scan(6003).count() == 4
    assert store.scan(3001).first().network.bytes_out == 5
    assert store.query_partition(6003, "activity_id = 1", limit=3).count() == 3
    assert store.query_partition(6003, "activity_id = 9").count() == 0
    assert store.append(events.limit(0)) == 0
    assert [r.event_count for r in store.audit.ingest_history().collect()] == [0, 2, 3]


def test_repeated_run_leaves_no_copies(store, make_events):
    events = make_events([{"class_uid": 3001}, {"class_uid": 6003}])
    store.append(events, run_id="r1")
    store.append(events, run_id="r1")
    assert store.scan_all().count() == 2


def test_replay_is_separate(store, make_events):
    events = make_events([{"class_uid": 3001}, {"class_uid": 6003}])
    store.append(events)
    session = store.create_session("drill")
    assert store.append_replay(events, session) == 2
    assert store.scan(3001).count() == 1
    assert store.scan(3001, include_replay=True).count() == 1
    assert store.scan(3001, include_replay=True, session_id=session).count() == 2
    assert store.scan(3001, include_replay=True, session_id="none").count() == 1
    assert store.available_partitions() == [3001, 6003]
    with pytest.raises(ReplaySessionNotFoundError):
        store.scan_replay("none")
    for bad in ("", "  ", "a/b"):
        with pytest.raises(ValueError):
            store.append_replay(events, bad)
    with pytest.raises(ValueError):
        store.create_session(" ")


def test_ingest_files_to_events_and_quarantine(spark, store, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.log").write_text("\n".join(APACHE.format(i) for i in range(5)) + "\n\nbad line\n")
    result = ingest_files(spark, str(logs), "apache", 3002, store)
    assert (result.parsed_count, result.failed_parse, result.normalised_count, result.written_count) == (5, 1, 5, 5)
    assert result.summary() == "✅ Ingested 5 events (1 parse failures, 0 normalise failures)"
    assert failure_summary("x") == "❌ Ingest failed: x"
    assert {r.http.request.url.path for r in store.scan(3002).collect()} == {f"/{i}" for i in range(5)}
    quarantine = store.quarantine().collect()
    assert [(r.raw_line, r.failure, r.class_uid) for r in quarantine] == [("bad line", "parse", 3002)]
    entry = store.audit.ingest_history().first()
    assert (entry.event_count, entry.failed_count, entry.source_format, entry.class_uid) == (5, 1, "apache", 3002)


def test_dropped_fields_are_audited(spark, store, make_lines):
    from tidewatch.operators.normalize import MappingRegistry

    mappings = MappingRegistry()
    mappings.register_mapping("apache", 3002, {"status": "http.response.code", "user": "actor.user.name"})
    result = ingest_lines(make_lines([APACHE.format(1)]), "apache", 3002, store, mappings)
    assert (result.written_count, result.failed_normalise) == (0, 1)
    assert store.audit.query_history().first().sql_template == "DROPPED_FIELDS:user"
    assert store.quarantine().first().failure == "normalise"


def test_audited_query(store, make_events):
    store.append(make_events([{"class_uid": 3001, "dst_endpoint.port": p} for p in (80, 80, 443)]))
    rows = run_event_query(store, lambda df: df.collect(), 3001, {"dst_endpoint.port": 80}, session_id="s")
    assert len(rows) == 2
    spec = QuerySpec(3001, (FieldFilter("dst_endpoint.port", "gt", 80),))
    assert run_spec(store, lambda df: df.count(), spec) == 1
    with pytest.raises(PartitionNotFoundError):
        run_event_query(store, lambda df: df.count(), 1001, session_id="s")
    with pytest.raises(TypeError):
        run_event_query(store, lambda df: df.count(), None)
    log = store.audit.query_history("s").orderBy("executed_at").collect()
    assert [(r.success, r.row_count) for r in log] == [(True, 2), (False, None)]
    assert "no events stored" in log[1].failure_reason and log[0].latency_ms > 0
    with pytest.raises(ValueError):
        store.audit.query_history(limit=0)


def test_audit_failure_does_not_fail_the_query(spark, tmp_path, capsys):
    blocked = tmp_path / "file"
    blocked.write_text("x")
    AuditLog(spark, str(blocked)).log_query("s", "q")
    assert "not written" in capsys.readouterr().err


def test_shared_folder_is_required_on_clusters(monkeypatch):
    from tidewatch import session
    from tidewatch.errors import SharedFolderError

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(SharedFolderError):
        session.shared_dir(Session())


def test_slower_baseline_writer_fails(spark, tmp_path):
    from tidewatch.errors import ConcurrentUpdateError
    from tidewatch.sources.baselines import SCHEMA, BaselineStore
    from tidewatch.sources.paths import create_text

    def rows(value):
        return spark.createDataFrame([("ip", value, "m", 3001, 1.0, 1.0, 30, "a", "b", "c")], SCHEMA)

    store = BaselineStore(spark, str(tmp_path / "b"))
    store.upsert(rows("1"))
    assert store.upsert(rows("2")).count() == 2
    current = store.table.manifest()
    create_text(spark, f"{store.table.root}/current/{3:012d}.txt", "other")
    store.table.manifest = lambda: current
    with pytest.raises(ConcurrentUpdateError):
        store.upsert(rows("3"))


def test_time_range_opens_only_its_days(spark, tmp_path, make_events):
    from datetime import datetime

    from tidewatch.plans.investigate import event_query
    from tidewatch.sources.store import EventStore

    store = EventStore(spark, str(tmp_path / "s"))
    store.append(make_events([{"time": f"2026-01-{d:02d}T12:00:00Z", "class_uid": 6003} for d in range(1, 11)]), run_id="r")
    found = event_query(store, 6003, None, (datetime(2026, 1, 3), datetime(2026, 1, 4, 23)))
    assert found.count() == 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "event_date" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_repeated_run_leaves_no_old_partitions(spark, tmp_path, make_lines):
    from datetime import datetime, timezone

    from tidewatch.plans.ingest import ingest_lines
    from tidewatch.sources.store import EventStore

    store = EventStore(spark, str(tmp_path / "s"))
    good = '1.1.1.1 - u [01/Jan/2026:00:00:00 +0000] "GET /x HTTP/1.1" 200 5'
    at = datetime(2026, 1, 1, tzinfo=timezone.utc)
    ingest_lines(make_lines([good, "garbage"]), "apache", 3002, store, run_id="r", ingest_time=at)
    assert store.quarantine().count() == 1
    ingest_lines(make_lines([good]), "apache", 3002, store, run_id="r", ingest_time=at)
    left = store.quarantine()
    assert (left is None or left.count() == 0) and store.scan(3002).count() == 1


def test_indicator_list_without_a_cap(spark):
    lines = spark.range(120_000).selectExpr("concat('v', id) AS value", "'f' AS file_path", "0L AS block_start", "id AS seq")
    assert S.indicator_rows(lines).count() == 120_000


def test_scratch_is_removed_on_request(spark, monkeypatch):
    from tidewatch import session

    monkeypatch.setattr(session, "_scratch", [])
    table = session.settled(spark.range(3), "test")
    assert table.count() == 3 and len(session._scratch) == 1
    session.scratch_path(spark, "never-written")
    assert session.remove_scratch(spark) == 1 and not session._scratch


def test_large_lists_touch_only_events_that_may_hit(spark, make_events):
    events = make_events([{"src_endpoint.ip": f"10.1.{i // 200}.{i % 200}", "actor.user.name": f"User{i}"} for i in range(2000)])
    listed = spark.range(3000).select(F.when(F.col("id") < 40, F.concat(F.lit("user"), F.col("id") * 50)).otherwise(F.concat(F.lit("172.16.0.0/"), "id")).alias("ioc"))
    large = I.LargeList(listed, max_bytes=0)
    suspects = events.where(large.may_hit())
    assert 40 <= suspects.count() < 80
    hits = I.indicator_hits(events, listed, max_bytes=5000)
    assert {(r.id, tuple(r.ioc_matches)) for r in hits.select("id", "ioc_matches").collect()} == {(i, (f"User{i}",)) for i in range(0, 2000, 50)}
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "getbit" in plan and "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning") == 0
    # A list that is large even after it was cut down: events that may hit something are shuffled, no others.
    plan = I.indicator_hits(events, listed, max_bytes=0)._jdf.queryExecution().executedPlan().toString()
    for branch in plan.split("Exchange hashpartitioning")[1:]:
        assert "getbit" in branch or "indicators-present" in branch or "indicator-values" in branch
    assert I.mark_indicators(events, listed, max_bytes=0).count() == 2000


def rows_read(df):
    """Rows that the file scan of a query handed on, after whole row groups were left out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaf = (plan.executedPlan() if plan.getClass().getSimpleName().startswith("AdaptiveSpark") else plan).collectLeaves().head()
    return leaf.metrics().get("numOutputRows").get().value()


def test_a_needle_is_found_in_few_row_groups(spark, make_events, tmp_path):
    n = 20_000
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    before = hadoop.get("parquet.block.size")
    hadoop.set("parquet.block.size", "65536")
    try:
        store = EventStore(spark, str(tmp_path / "needles"))
        flat = spark.range(n).select(
            F.lit(3001).alias("class_uid"),
            F.concat(F.lit("10."), (F.col("id") % 97).cast("string"), F.lit("."), (F.col("id") * 31 % 5003).cast("string")).alias("ip"),
            F.concat(F.lit("192.168."), (F.col("id") * 7919 % n).cast("string")).alias("dst"),
        )
        events = make_events([{"class_uid": 3001}]).drop("id").crossJoin(flat.select("ip", "dst")).withColumns(
            {"src_endpoint": F.col("src_endpoint").withField("ip", F.col("ip")), "dst_endpoint": F.col("dst_endpoint").withField("ip", F.col("dst"))}
        ).drop("ip", "dst")
        assert store.append(events, run_id="r") == n
        wanted = flat.where("id = 4711").first()
        by_source = event_query(store, 3001, {"src_endpoint.ip": wanted.ip})
        by_target = event_query(store, 3001, {"dst_endpoint.ip": wanted.dst})
        assert by_source.count() == flat.where(F.col("ip") == wanted.ip).count() and by_target.count() == 1
        assert 0 < rows_read(by_source.select("time", "src_endpoint.ip")) < n / 4  # sorted: few row groups can hold it
        assert 0 < rows_read(by_target.select("time", "dst_endpoint.ip")) < n / 2  # not sorted by it: the Bloom filters tell
    finally:
        hadoop.set("parquet.block.size", before or "134217728")


def test_a_registry_without_the_sorted_fields(spark, tmp_path):
    from tidewatch.registry import FieldRegistry
    from tidewatch.sources.store import _has_field

    full = FieldRegistry.default()
    registry = FieldRegistry([full.get_field_definition(p) for p in full.paths if not p.startswith(("src_endpoint", "actor"))])
    store = EventStore(spark, str(tmp_path / "few"), registry)
    assert not _has_field(store.event_schema(), "src_endpoint.ip") and _has_field(store.event_schema(), "dst_endpoint.ip")
    events = spark.sql("SELECT 3001 AS class_uid, 1 AS activity_id, 1 AS severity_id, timestamp'2026-01-01' AS time")
    assert store.append(events, run_id="r") == 1 and store.scan(3001).count() == 1
