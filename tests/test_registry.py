import json

import pytest
from pyspark.sql import types as T

from tidewatch.errors import UnsupportedClassError
from tidewatch.registry import REQUIRED_FIELDS, FieldRegistry, MetricRegistry


def test_default_has_45_paths_and_five_classes(registry):
    assert len(registry.paths) == 45
    assert registry.get_required_fields(3001) == list(REQUIRED_FIELDS)


def test_lookup_by_class_and_type(registry):
    assert registry.is_valid_field("dst_endpoint.hostname", 6003)
    assert not registry.is_valid_field("file.path", 3001)
    assert registry.get_field_type("dns.answers") == "VARCHAR[]"
    assert registry.get_field_type("nope") is None
    with pytest.raises(TypeError):
        registry.get_field_definition(None)
    with pytest.raises(UnsupportedClassError):
        registry.get_fields_for_class(9)


def test_struct_type_is_nested_and_typed(registry):
    schema = registry.struct_type()
    assert schema["network"].dataType["bytes_out"].dataType == T.LongType()
    assert schema["http"].dataType["request"].dataType["url"].dataType["path"].dataType == T.StringType()
    assert schema["time"].dataType == T.TimestampType()


def test_dataframe(spark, registry):
    df = registry.to_dataframe(spark)
    assert df.count() == 45
    assert df.where("required").count() == 6


def test_json_merges_duplicates(tmp_path):
    entry = {"field_path": "a.b", "field_type": "VARCHAR", "required": False, "applicable_classes": [3001], "source_examples": ["x"]}
    other = {**entry, "required": True, "applicable_classes": [6003], "source_examples": ["x", "y"]}
    path = tmp_path / "fields.json"
    path.write_text(json.dumps({"version": "9", "fields": [entry, other]}))
    registry = FieldRegistry.from_json(path)
    found = registry.get_field_definition("a.b")
    assert found.applicable_classes == (3001, 6003)
    assert found.required and found.source_examples == ("x", "y")
    assert registry.version == "9"


@pytest.mark.parametrize("text", ["{", "[]", "{}", '{"fields": [{"field_path": "x"}]}'])
def test_bad_json(tmp_path, text):
    path = tmp_path / "bad.json"
    path.write_text(text)
    with pytest.raises(ValueError):
        FieldRegistry.from_json(path)


def test_missing_file_and_none():
    with pytest.raises(FileNotFoundError):
        FieldRegistry.from_json("/does/not/exist.json")
    with pytest.raises(TypeError):
        FieldRegistry.from_json(None)
    with pytest.raises(ValueError):
        MetricRegistry.from_json("  ")


def test_metrics():
    metrics = MetricRegistry.default()
    assert len(metrics.all()) == 9
    assert {m.metric_name for m in metrics.get_metrics_for_class(4001)} == {
        "process_exec_count", "process_distinct_names", "child_process_spawn_rate",
    }
    assert metrics.get_metric("process_exec_count", 3001) is None
    with pytest.raises(ValueError):
        metrics.require("process_exec_count", 3001)
    with pytest.raises(UnsupportedClassError):
        metrics.get_metrics_for_class(1)


def test_metric_json(tmp_path):
    good = {"metric_name": "m", "class_uid": 3001, "entity_type": "ip", "entity_field": "src_endpoint.ip", "computation": "count"}
    path = tmp_path / "metrics.json"
    path.write_text(json.dumps({"metrics": [good]}))
    assert MetricRegistry.from_json(path).require("m", 3001).target_field is None
    for rows in ([good, good], [{**good, "computation": "median"}], [{"metric_name": "m"}]):
        path.write_text(json.dumps({"metrics": rows}))
        with pytest.raises(ValueError):
            MetricRegistry.from_json(path)
