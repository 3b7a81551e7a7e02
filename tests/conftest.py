from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

from tidewatch.operators.events import event_columns
from tidewatch.registry import FieldRegistry
from tidewatch.session import configure


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def registry():
    return FieldRegistry.default()


@pytest.fixture(scope="session")
def make_events(spark, registry):
    """Events from dicts of path -> value; missing required fields get defaults."""
    from pyspark.sql import functions as F

    defaults = {
        "class_uid": 6003,
        "activity_id": 1,
        "severity_id": 1,
        "time": "2026-01-01T00:00:00Z",
        "metadata.log_source": "test",
        "metadata.original_time": "t",
    }

    def build(rows: list[dict]):
        rows = [{"id": i, **defaults, **row} for i, row in enumerate(rows)]
        names = list(dict.fromkeys(n for row in rows for n in row))
        kinds = {n: registry.get_field_definition(n).spark_type.simpleString() if n != "id" else "bigint" for n in names}
        kinds["time"] = "string"
        schema = ", ".join(f"`{n}` {kinds[n]}" for n in names)
        flat = spark.createDataFrame([tuple(row.get(n) for n in names) for row in rows], schema)
        values = {n: F.col(f"`{n}`") for n in names if n != "id"}
        values["time"] = F.to_timestamp("time")
        return flat.select("id", *event_columns(values, registry))

    return build


@pytest.fixture
def make_lines(spark):
    def build(values, file="f", block=0):
        return spark.createDataFrame(
            [(v, file, block, i) for i, v in enumerate(values)],
            "value string, file_path string, block_start bigint, seq bigint",
        )

    return build
