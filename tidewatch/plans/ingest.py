"""Lines in, events and quarantine out, in one Spark job."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.normalize import MappingRegistry, dropped_fields, ingest_counts, normalize
from tidewatch.operators.parse import format_name, parse
from tidewatch.sources.lines import read_lines, read_xml_records
from tidewatch.sources.paths import remove_folders
from tidewatch.sources.store import PARTITIONS, EventStore, event_date, new_run_id, write_partitions


@dataclass(frozen=True)
class IngestResult:
    run_id: str
    parsed_count: int
    failed_parse: int
    normalised_count: int
    failed_normalise: int
    written_count: int

    def summary(self) -> str:
        return (
            f"✅ Ingested {self.written_count} events "
            f"({self.failed_parse} parse failures, {self.failed_normalise} normalise failures)"
        )


def failure_summary(error: object) -> str:
    return f"❌ Ingest failed: {error}"


def prepare(
    lines: DataFrame,
    source_format: str,
    class_uid: int,
    mappings: MappingRegistry,
    ingest_time: datetime,
    store: EventStore,
    **parse_options,
) -> DataFrame:
    """Parsed, typed, tagged and judged rows; bad ones keep their line and the reason."""
    mapping = mappings.get(source_format, class_uid)
    parsed = parse(lines, source_format, **parse_options)
    return normalize(parsed, mapping, class_uid, ingest_time, store.registry)


def ingest_lines(
    lines: DataFrame,
    source_format: str,
    class_uid: int,
    store: EventStore,
    mappings: MappingRegistry | None = None,
    run_id: str | None = None,
    ingest_time: datetime | None = None,
    file_path: str | None = None,
    compact: bool = True,
    **parse_options,
) -> IngestResult:
    """One pass over the lines; every line ends up as an event or in quarantine.

    The write goes to partitions named by the run, so doing a run again replaces
    its rows, those of an earlier try that failed or found more included. ``compact``
    adds a shuffle that evens out file sizes per day. Totals are observed in the writing job.
    """
    mappings = mappings or MappingRegistry.default()
    run_id = run_id or new_run_id()
    ingest_time = ingest_time or datetime.now(timezone.utc)
    rows = prepare(lines, source_format, class_uid, mappings, ingest_time, store, **parse_options)
    seen = Observation()
    out = rows.observe(seen, *ingest_counts()).select(
        *[
            (F.when(F.col("is_valid"), F.col(name)) if name != "class_uid" else F.lit(class_uid)).alias(name)
            for name in store.event_schema().names
        ],
        F.when(~F.col("is_valid"), F.col("value")).alias("raw_line"),
        F.when(~F.col("is_parsed"), "parse").when(~F.col("is_valid"), "normalise").alias("failure"),
        F.when(F.col("is_valid"), "events").otherwise("quarantine").alias("table"),
        F.when(F.col("is_valid"), event_date()).otherwise("none").alias("event_date"),
        F.lit(run_id).alias("run"),
    )
    if compact:
        out = out.hint("rebalance", "table", "event_date")
    remove_folders(store.spark, f"{store.root}/table=*/class_uid={class_uid}/event_date=*/run={run_id}")
    write_partitions(out, store.root, PARTITIONS)
    counts = seen.get
    result = IngestResult(run_id=run_id, **{k: int(v or 0) for k, v in counts.items()})
    if store.audit is not None:
        dropped = dropped_fields(mappings.get(source_format, class_uid), class_uid, store.registry)
        if dropped:
            store.audit.log_query(
                "normalizer",
                f"DROPPED_FIELDS:{','.join(dropped)}",
                class_uid,
                success=False,
                failure_reason=f"Fields not registered for class {class_uid}",
            )
        store.audit.log_ingest(
            run_id,
            format_name(source_format),
            result.written_count,
            result.failed_parse + result.failed_normalise,
            file_path,
            class_uid,
        )
    return result


def ingest_files(
    spark: SparkSession, paths, source_format: str, class_uid: int, store: EventStore, encoding: str = "file", **options
) -> IngestResult:
    evtx = format_name(source_format) == "evtx"
    lines = read_xml_records(spark, paths) if evtx else read_lines(spark, paths, encoding)
    named = paths if isinstance(paths, str) else ",".join(paths)
    return ingest_lines(lines, source_format, class_uid, store, file_path=named, **options)
