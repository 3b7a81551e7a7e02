"""Pages out of a range-partitioned result, and distinct counts out of stored sketches."""

import random

import pytest

from tidewatch.operators import sketches as K
from tidewatch.operators import system
from tidewatch.registry import MetricDefinition
from tidewatch.sources.baselines import SketchStore


def test_pages_equal_a_sorted_list(spark):
    rng = random.Random(2)
    values = [(rng.randrange(50), i) for i in range(1037)]
    rows = spark.createDataFrame(values, "time int, id int").repartition(5)
    index = system.PageIndex(rows, order=("time", "id"), page_size=100, parts=6)
    want = sorted(values)
    assert index.pages == 11 and index.row_count == 1037
    for page in (0, 1, 5, 9, 10):
        assert [tuple(r) for r in index.page(page).collect()] == want[page * 100 : page * 100 + 100]
    assert [tuple(r) for r in index.page(99).collect()] == want[1000:] and index.page(-3).count() == 100


def test_a_deep_page_opens_one_part(spark):
    rows = spark.range(10_000).withColumnRenamed("id", "time")
    index = system.PageIndex(rows, order=("time",), page_size=10, parts=20)
    opened = [index.parts_of(p)[0] for p in range(index.pages)]
    assert max(map(len, opened)) <= 2 and sum(len(o) == 1 for o in opened) > 0.95 * index.pages
    page = 777 if len(opened[777]) == 1 else 778
    read = index.page(page)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_part" in plan
    assert [r.time for r in read.collect()] == list(range(page * 10, page * 10 + 10))
    files = {f.split("_part=")[1].split("/")[0] for f in index._stored().where(f"_part IN ({opened[page][0]})").inputFiles()}
    assert files  # the parts are folders of their own


def test_pages_of_nothing_and_bad_sizes(spark):
    rows = spark.range(0).withColumnRenamed("id", "time")
    index = system.PageIndex(rows, order=("time",))
    assert index.pages == 1 and index.page(0).collect() == [] and index.page(3).columns == ["time"]
    with pytest.raises(ValueError):
        system.PageIndex(rows, page_size=0)


METRIC = MetricDefinition("users", 3001, "ip", "src_endpoint.ip", "distinct_field_count", "actor.user.name")


def test_sketches_of_days_unite(make_events, spark, tmp_path):
    rows = [
        {"class_uid": 3001, "src_endpoint.ip": f"10.0.0.{i % 3}", "actor.user.name": f"u{i * 7 % 2000}", "time": f"2026-01-0{1 + i % 4}T00:00:00Z"}
        for i in range(6000)
    ] + [{"class_uid": 3001, "src_endpoint.ip": "10.0.0.9", "actor.user.name": None}]
    events = make_events(rows)
    store = SketchStore(spark, str(tmp_path / "s"), buckets=2)
    for day in (1, 2, 2, 3, 4):
        store.put_days(K.daily_sketches(events.where(f"day(time) = {day}"), METRIC))
    got = {r.entity_value: r.value for r in K.distinct_counts(store.read()).collect()}
    once = {r.entity_value: r.value for r in K.distinct_counts_once(events, METRIC).collect()}
    want = {}
    for r in rows:
        want.setdefault(r["src_endpoint.ip"], set()).add(r["actor.user.name"])
    want = {k: len(v - {None}) for k, v in want.items()}
    assert got.keys() == want.keys() == once.keys()
    for key, n in want.items():
        assert abs(got[key] - n) <= 0.02 * n and abs(once[key] - n) <= 0.02 * n
