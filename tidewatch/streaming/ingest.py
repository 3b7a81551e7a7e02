"""Continuous ingest of a folder of log files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidewatch.operators.normalize import MappingRegistry
from tidewatch.operators.parse import format_name
from tidewatch.plans.ingest import ingest_lines
from tidewatch.sources.lines import RECORD_END, decode_lines, number_lines, split_lines, xml_records
from tidewatch.sources.store import EventStore


def stream_lines(spark: SparkSession, path: str, max_files_per_trigger: int | None = None, source_format: str | None = None) -> DataFrame:
    """Text as it arrives: lines, or for event XML whole records however they are laid out."""
    reader = spark.readStream
    if source_format is not None and format_name(source_format) == "evtx":
        reader = reader.option("lineSep", RECORD_END)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
    )


def start_ingest(
    lines: DataFrame,
    source_format: str,
    class_uid: int,
    store: EventStore,
    checkpoint: str,
    name: str = "ingest",
    mappings: MappingRegistry | None = None,
    ingest_time: datetime | None = None,
    trigger: dict | None = None,
    **parse_options,
) -> StreamingQuery:
    """Every micro-batch is one ingest run named by its batch id. ``lines`` come from ``stream_lines`` for the same format.

    A batch that is repeated after a failure overwrites its own partitions, so
    events are stored once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        text = decode_lines(batch)
        numbered = number_lines(xml_records(text) if format_name(source_format) == "evtx" else split_lines(text))
        ingest_lines(
            numbered, source_format, class_uid, store, mappings,
            run_id=f"{name}-{batch_id:010d}", ingest_time=ingest_time, **parse_options,
        )

    return (
        lines.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
