import pytest
from pyspark.sql import functions as F

from tidewatch.operators import intents, system


def queries(spark, rows):
    return spark.createDataFrame(rows, "executed_at string, success boolean, latency_ms double").withColumn("executed_at", F.to_timestamp("executed_at"))


def ingests(spark, rows):
    return spark.createDataFrame(rows, "ingested_at string, source_format string, class_uid int, event_count bigint").withColumn(
        "ingested_at", F.to_timestamp("ingested_at"))


def test_system_metrics(spark):
    q = queries(spark, [("2026-01-01", True, 10.0), ("2026-01-02", True, None), ("2026-01-03", False, 99.0), ("2026-01-04", True, 30.0)])
    i = ingests(spark, [("2026-01-01", "zeek", None, 5), ("2026-01-02", "evtx", 4001, 7)])
    rules = spark.createDataFrame([(True,), (False,)], "analyst_confirmed boolean")
    row = system.system_metrics(q, i, rules).first()
    assert (row.total_queries, row.successful_queries, row.failed_queries, row.avg_query_latency_ms) == (4, 3, 1, 20.0)
    assert (row.total_ingest_events, row.total_ingest_runs, row.rules_stored, row.rules_confirmed) == (12, 2, 2, 1)
    assert system.system_metrics(q, i, limit=2).first().total_queries == 2
    assert system.success_rate(q).first().success_rate == 75.0
    empty = system.system_metrics(q.limit(0), i.limit(0)).first()
    assert empty.total_queries == 0 and empty.avg_query_latency_ms is None and empty.total_ingest_events == 0
    assert system.success_rate(q.limit(0)).first().success_rate == 0.0


def test_top_classes(spark):
    i = ingests(spark, [("2026-01-01", f, c, n) for f, c, n in [("Zeek", None, 5), ("apache", None, 9), ("evtx", 4001, 7), ("other", None, 99)]])
    assert [(r.class_uid, r.event_count) for r in system.top_event_classes(i, 2).collect()] == [(3002, 9), (4001, 7)]
    with pytest.raises(ValueError):
        system.top_event_classes(i, 0)


def test_paging(spark):
    rows = spark.range(105).withColumnRenamed("id", "time")
    page, pages = system.paginate(rows, 99, 50)
    assert pages == 3 and [r.time for r in page.collect()] == list(range(100, 105))
    page, _ = system.paginate(rows, -1, 50)
    assert page.first().time == 0
    assert system.paginate(rows.limit(0), 0)[1] == 1
    assert [r.time for r in system.page_after(rows, {"time": 49}, 3).collect()] == [50, 51, 52]
    with pytest.raises(ValueError):
        system.paginate(rows, 0, 0)


GOOD = '{"class_uid": 3001, "filters": [{"field_path": "a", "operator": "eq", "value": 5}, {"field_path": "b", "operator": "like", "value": 1}, {"field_path": " ", "operator": "eq"}, {"field_path": "c", "operator": "is_null"}], "time_range_hours": 24, "confidence": 1.7}'


@pytest.mark.parametrize(
    "text, want",
    [
        (GOOD, (3001, [("a", "eq", "5"), ("c", "is_null", None)], 24, 1.0)),
        (f"```json\n{GOOD}\n```", (3001, [("a", "eq", "5"), ("c", "is_null", None)], 24, 1.0)),
        ('{"confidence": -2, "time_range_hours": 0}', (None, [], None, 0.0)),
        ('{"class_uid": null, "filters": null, "confidence": "x", "time_range_hours": "7"}', (None, [], 7, None)),
        ('{"class_uid": 6003, "filters": "oops"}', (6003, [], None, None)),
        ("not json", (None, [], None, 0.0)),
        ("[1, 2]", (None, [], None, 0.0)),
        ('{"class_uid": 3001', (None, [], None, 0.0)),
        ("", (None, [], None, 0.0)),
        (None, (None, [], None, 0.0)),
    ],
)
def test_decode(spark, text, want):
    intent = intents.decode_intents(spark.createDataFrame([(text,)], "response string")).first().intent
    got = (intent.class_uid, [(f.field_path, f.operator, f.value) for f in intent.filters or []], intent.time_range_hours, intent.confidence)
    assert got == want
    assert intents.intent_to_spec(intent).is_valid() == (want[0] is not None)
