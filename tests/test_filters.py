from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidewatch.errors import UnsupportedClassError
from tidewatch.operators import filters as X
from tidewatch.operators.events import class_projection, dedup_events, display_columns, flatten_events
from tidewatch.operators.filters import FieldFilter, QuerySpec


@pytest.fixture(scope="module")
def events(make_events):
    return make_events(
        [
            {"class_uid": 3001, "dst_endpoint.port": 80, "src_endpoint.ip": "1.1.1.1", "dns.answers": ["a", "b"]},
            {"class_uid": 3001, "dst_endpoint.port": 443, "src_endpoint.ip": "It's"},
            {"class_uid": 3001, "time": "2026-01-02T00:00:00.5Z"},
            {"class_uid": 6003},
        ]
    ).cache()


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


@pytest.mark.parametrize(
    "item, want",
    [
        (FieldFilter("dst_endpoint.port", "eq", 80), [0]),
        (FieldFilter("dst_endpoint.port", "eq", "80"), [0]),
        (FieldFilter("dst_endpoint.port", "eq", "abc"), []),
        (FieldFilter("dst_endpoint.port", "eq", None), [2]),
        (FieldFilter("dst_endpoint.port", "ne", 80), [1]),
        (FieldFilter("dst_endpoint.port", "gt", 80), [1]),
        (FieldFilter("dst_endpoint.port", "gte", 80), [0, 1]),
        (FieldFilter("dst_endpoint.port", "lt", 443), [0]),
        (FieldFilter("dst_endpoint.port", "lte", 80.5), [0]),
        (FieldFilter("dst_endpoint.port", "is_null"), [2]),
        (FieldFilter("dst_endpoint.port", "not_null"), [0, 1]),
        (FieldFilter("activity_id", "eq", True), [0, 1, 2]),
        (FieldFilter("src_endpoint.ip", "eq", "It's"), [1]),
        (FieldFilter("src_endpoint.ip", "contains", "IT"), [1]),
        (FieldFilter("dst_endpoint.port", "contains", "44"), [1]),
        (FieldFilter("dns.answers", "contains", "A"), [0]),
        (FieldFilter("dns.answers", "eq", "b"), [0]),
        (FieldFilter("time", "gt", "2026-01-01T12:00:00"), [2]),
        (FieldFilter("file.path", "eq", "ignored"), [0, 1, 2]),
    ],
)
def test_operators(events, registry, item, want):
    assert ids(X.filter_events(events, 3001, [item], registry=registry)) == want


def test_mapping_means_equality(events, registry):
    assert ids(X.filter_events(events, 3001, {"dst_endpoint.port": 80, "src_endpoint.ip": "1.1.1.1"}, registry=registry)) == [0]
    assert ids(X.filter_events(events, 3001, {"dst_endpoint.port": None}, registry=registry)) == [2]


def test_time_range_is_inclusive_in_whole_seconds(events, registry):
    day = datetime(2026, 1, 1, tzinfo=timezone.utc)
    assert ids(X.filter_events(events, 3001, None, (day, day), registry)) == [0, 1]
    assert ids(X.filter_events(events, 3001, None, (day, datetime(2026, 1, 2, 0, 0, 0, 900000)), registry)) == [0, 1]


def test_look_back(events):
    at = F.lit("2026-01-02 00:00:01").cast("timestamp")
    assert ids(events.where(X.look_back(1, at))) == [2]
    with pytest.raises(ValueError):
        X.look_back(0, at)


def test_known_and_ignored(registry):
    known, ignored = X.split_known({"file.path": 1, "status": "x"}, 3001, registry)
    assert [f.field_path for f in known] == ["status"] and [f.field_path for f in ignored] == ["file.path"]


def test_checks(events):
    with pytest.raises(ValueError):
        FieldFilter("a", "like")
    with pytest.raises(ValueError):
        FieldFilter(" ")
    with pytest.raises(TypeError):
        FieldFilter(None)
    with pytest.raises(ValueError):
        QuerySpec(confidence=1.1)
    with pytest.raises(ValueError):
        QuerySpec(time_range_hours=0)
    with pytest.raises(ValueError):
        QuerySpec().require_valid()
    with pytest.raises(UnsupportedClassError):
        X.filter_events(events, 1)
    spec = QuerySpec(3001, time_range_hours=2)
    low, high = spec.time_range(datetime(2026, 1, 1, 5))
    assert (high - low).total_seconds() == 7200 and QuerySpec(3001).time_range() is None


def test_pushdown_reaches_the_scan(spark, events, registry, tmp_path):
    path = str(tmp_path / "events")
    events.write.partitionBy("class_uid").parquet(path)
    stored = spark.read.schema(events.schema).parquet(path)
    rows = X.filter_events(stored, 3001, {"dst_endpoint.port": 80}, registry=registry).select("id")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(dst_endpoint.port,80)" in plan
    assert "PartitionFilters: [isnotnull(class_uid" in plan
    assert "bytes_out" not in plan.split("ReadSchema")[1]


def test_flatten_project_display(events, registry):
    flat = flatten_events(events)
    assert "src_endpoint.ip" in flat.columns and len(flat.columns) == 46
    assert len(class_projection(events, 1001, registry).columns) == 13
    assert display_columns(flat.columns)[0] == "time" and len(display_columns(flat.columns)) == 8
    assert display_columns(list("abcdefghij")) == list("abcdefgh")
    assert len(display_columns([])) == 8


def test_dedup(events):
    assert ids(dedup_events(events, keep_first_by=["id"])) == [0, 2, 3]
    assert dedup_events(events).count() == 3
