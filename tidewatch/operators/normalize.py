"""Raw fields to typed events: mapping, coercion, validity, validation report."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.errors import UnregisteredFormatError
from tidewatch.functions.coerce import parse_int, parse_time, to_registry_type
from tidewatch.functions.ipaddr import is_ip
from tidewatch.functions.text import pinned, strip
from tidewatch.operators.events import event_columns
from tidewatch.operators.parse import format_name, raw_field
from tidewatch.operators.techniques import BUILTIN_RULES, technique_ids
from tidewatch.registry import REQUIRED_FIELDS, FieldRegistry


_TIMES = ("time", "metadata.original_time")


@dataclass(frozen=True)
class FieldMapping:
    """How the raw fields of one format fill the events of one class.

    ``fields`` maps raw name -> event path, or several paths. ``constants`` fills paths no raw field
    provides. ``time_formats`` are tried after epoch seconds and ISO 8601.
    """

    fields: Mapping[str, str | tuple[str, ...]]
    constants: Mapping[str, Any] = field(default_factory=dict)
    time_formats: tuple[str, ...] = ()

    def pairs(self) -> list[tuple[str, str]]:
        return [
            (raw, path)
            for raw, paths in self.fields.items()
            for path in ((paths,) if isinstance(paths, str) else paths)
        ]


class MappingRegistry:
    """(format, class) -> mapping; each pair is registered once."""

    def __init__(self):
        self._mappings: dict[tuple[str, int], FieldMapping] = {}

    def register_mapping(self, source_format: str, class_uid: int, mapping: FieldMapping | Mapping[str, str]) -> None:
        for name, value in (("source_format", source_format), ("class_uid", class_uid), ("mapping", mapping)):
            if value is None:
                raise TypeError(f"{name} must not be None")
        if not isinstance(mapping, FieldMapping):
            mapping = FieldMapping(dict(mapping))
        if not mapping.fields:
            raise ValueError("a mapping needs at least one field")
        key = (format_name(source_format), class_uid)
        if key in self._mappings:
            raise ValueError(f"a mapping for {key} is already registered")
        self._mappings[key] = mapping

    def get(self, source_format: str, class_uid: int) -> FieldMapping:
        key = (format_name(source_format), class_uid)
        if key not in self._mappings:
            raise UnregisteredFormatError(f"no field mapping for format '{source_format}' and class_uid={class_uid}")
        return self._mappings[key]

    @classmethod
    def default(cls, syslog_year: int | None = None) -> "MappingRegistry":
        """Mappings for the shipped parsers.

        Activity and severity are not in these logs, so they are set to 0, the
        schema's "unknown"; give other constants to say more.
        """
        unknown = {"activity_id": 0, "severity_id": 0}
        registry = cls()
        registry.register_mapping(
            "zeek",
            3001,
            FieldMapping(
                {
                    "ts": _TIMES,
                    "id.orig_h": "src_endpoint.ip",
                    "id.orig_p": "src_endpoint.port",
                    "id.resp_h": "dst_endpoint.ip",
                    "id.resp_p": "dst_endpoint.port",
                    "proto": "network.protocol",
                    "duration": "network.duration",
                    "orig_bytes": "network.bytes_out",
                    "resp_bytes": "network.bytes_in",
                    "conn_state": "status",
                },
                {**unknown, "metadata.log_source": "zeek"},
            ),
        )
        registry.register_mapping(
            "apache",
            3002,
            FieldMapping(
                {
                    "client_ip": "src_endpoint.ip",
                    "time": _TIMES,
                    "method": "http.request.method",
                    "uri": "http.request.url.path",
                    "status": "http.response.code",
                    "bytes": "http.response.length",
                    "referer": "http.request.referrer",
                    "user_agent": "http.user_agent",
                },
                {**unknown, "metadata.log_source": "apache"},
                ("dd/MMM/yyyy:HH:mm:ss Z",),
            ),
        )
        windows = {
            "TimeCreated": _TIMES,
            "SubjectUserName": "actor.user.name",
            "SubjectUserSid": "actor.user.uid",
        }
        registry.register_mapping(
            "evtx",
            4001,
            FieldMapping(
                {
                    **windows,
                    "ProcessName": "actor.process.name",
                    "ProcessId": "actor.process.pid",
                    "CommandLine": "actor.process.cmd_line",
                    "TargetProcessName": "process.name",
                    "TargetProcessId": "process.pid",
                    "TargetCommandLine": "process.cmd_line",
                },
                {**unknown, "metadata.log_source": "evtx"},
            ),
        )
        registry.register_mapping(
            "evtx",
            6003,
            FieldMapping(
                {
                    **windows,
                    "IpAddress": "src_endpoint.ip",
                    "Computer": "src_endpoint.hostname",
                    "WorkstationName": "dst_endpoint.hostname",
                    "AuthenticationPackageName": "auth.protocol",
                    "ServiceName": "auth.service",
                    "Status": "status",
                },
                {**unknown, "metadata.log_source": "evtx"},
            ),
        )
        year = syslog_year or datetime.now(timezone.utc).year
        registry.register_mapping(
            "syslog",
            1001,
            FieldMapping(
                {"timestamp": _TIMES, "message": "message"},
                {**unknown, "metadata.log_source": "syslog", "_year": year},
                ("yyyy MMM d HH:mm:ss",),
            ),
        )
        return registry


# Format of a source and the class its events go to, by the label an analyst picks.
# Fixed values.
FORMAT_CHOICES = {
    "Zeek conn.log (Network Activity)": ("zeek", 3001),
    "Apache Access Log (HTTP Activity)": ("apache", 3002),
    "Windows EVTX — Sysmon (Process Activity)": ("evtx", 4001),
    "Windows EVTX — Security (Authentication)": ("evtx", 6003),
    "Syslog (File System Activity)": ("syslog", 1001),
}


def dropped_fields(mapping: FieldMapping, class_uid: int, registry: FieldRegistry) -> list[str]:
    """Raw names whose path the class does not have; they are left out."""
    return [raw for raw, path in mapping.pairs() if not registry.is_valid_field(path, class_uid)]


def _raw_columns(parsed: DataFrame, mapping: FieldMapping, class_uid: int, registry: FieldRegistry) -> dict[str, Column]:
    """Event path -> raw text. Of several raw names for a path, the last non-null wins."""
    by_path: dict[str, list[Column]] = {}
    for raw_name, path in mapping.pairs():
        if not registry.is_valid_field(path, class_uid):
            continue
        if raw_name == "timestamp" and "_year" in mapping.constants:
            month, day, clock = (raw_field(parsed.schema, n) for n in ("month", "day", "time"))
            value = F.concat_ws(" ", F.lit(str(mapping.constants["_year"])), F.initcap(month), day, clock)
        else:
            value = raw_field(parsed.schema, raw_name)
        by_path.setdefault(path, []).insert(0, value)
    columns = {path: F.coalesce(*values) for path, values in by_path.items()}
    for path, constant in mapping.constants.items():
        if registry.is_valid_field(path, class_uid):
            text = F.lit(None if constant is None else str(constant)).cast("string")
            columns[path] = F.coalesce(columns[path], text) if path in columns else text
    return columns


def normalize(
    parsed: DataFrame,
    mapping: FieldMapping,
    class_uid: int,
    ingest_time: datetime,
    registry: FieldRegistry | None = None,
    rules=BUILTIN_RULES,
) -> DataFrame:
    """Parsed rows -> event columns plus ``is_parsed``, ``is_valid`` and ``time_fallback``.

    A row is valid when activity and severity are integers in range; a time that
    cannot be read becomes ``ingest_time`` and is flagged. Nothing is dropped.
    """
    registry = registry or FieldRegistry.default()
    registry.check_class(class_uid)
    # Plain text columns first: later steps read each of them several times, and a
    # field taken out of a struct would be computed anew each time.
    kept = [c for c in parsed.columns if c not in ("raw", "is_parsed")]
    source = _raw_columns(parsed, mapping, class_uid, registry)
    texts = parsed.select(
        *kept,
        "is_parsed",
        *[column.alias(f"_raw{i}") for i, column in enumerate(source.values())],
    )
    raw = {path: F.col(f"_raw{i}") for i, path in enumerate(source)}
    null = F.lit(None).cast("string")
    moment = parse_time(raw.get("time", null), mapping.time_formats)
    values: dict[str, Column] = {
        path: to_registry_type(column, registry.get_field_definition(path).spark_type) for path, column in raw.items()
    }
    values["class_uid"] = F.lit(class_uid)
    values["activity_id"] = parse_int(raw.get("activity_id", null))
    values["severity_id"] = parse_int(raw.get("severity_id", null))
    values["time"] = F.coalesce(moment, F.lit(ingest_time))
    for path in ("metadata.log_source", "metadata.original_time"):
        values[path] = F.coalesce(F.nullif(raw.get(path, null), F.lit("")), F.lit("unknown"))
    values.pop("mitre_technique_ids", None)
    events = texts.select(
        *kept,
        "is_parsed",
        (F.col("is_parsed") & moment.isNull()).alias("time_fallback"),
        *event_columns(values, registry),
    )
    found = technique_ids(rules, class_uid)
    return events.withColumn("is_valid", pinned(F.col("is_parsed") & row_is_valid())).withColumn(
        "mitre_technique_ids", F.when(F.col("is_valid") & (F.size(found) > 0), found)
    )


def row_is_valid() -> Column:
    """What the event constructor demands beyond the class."""
    texts = (strip(F.col("metadata.log_source")) != "") & (strip(F.col("metadata.original_time")) != "")
    numbers = (F.col("activity_id") >= 0) & F.col("severity_id").between(0, 6)
    return F.coalesce(texts & numbers & F.col("time").isNotNull(), F.lit(False))


def split_valid(normalized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, failed rows), both out of the rows that parsed."""
    return (
        normalized.where("is_valid"),
        normalized.where("is_parsed AND NOT is_valid"),
    )


def ingest_counts() -> list[Column]:
    """Run totals over normalised rows, usable in ``agg`` or ``observe``."""
    return [
        F.count_if("is_parsed").alias("parsed_count"),
        F.count_if(~F.col("is_parsed")).alias("failed_parse"),
        F.count_if("is_valid").alias("normalised_count"),
        F.count_if(F.col("is_parsed") & ~F.col("is_valid")).alias("failed_normalise"),
        F.count_if("is_valid").alias("written_count"),
    ]


def retype_rows(rows: DataFrame, class_uid: int, registry: FieldRegistry | None = None) -> DataFrame:
    """Stored flat rows (possibly text-typed) back to events of one class.

    Bad integers become 0, missing text "unknown", unreadable times the current
    time; fields of other classes and rows that still are not valid go.
    """
    registry = registry or FieldRegistry.default()
    have = set(rows.columns)

    def stored(path: str) -> Column:
        return F.col(f"`{path}`") if path in have else F.lit(None).cast("string")

    values = {
        d.field_path: (
            stored(d.field_path)
            if d.field_path in have and rows.schema[d.field_path].dataType == d.spark_type
            else to_registry_type(stored(d.field_path), d.spark_type)
        )
        for d in registry.get_fields_for_class(class_uid)
    }
    values["class_uid"] = F.lit(class_uid)
    for path in ("activity_id", "severity_id"):
        values[path] = F.coalesce(parse_int(stored(path)), F.lit(0))
    values["time"] = F.coalesce(values["time"], F.current_timestamp())
    for path in ("metadata.log_source", "metadata.original_time"):
        values[path] = F.coalesce(F.nullif(stored(path).cast("string"), F.lit("")), F.lit("unknown"))
    return rows.select(*event_columns(values, registry)).where(row_is_valid())


def validation_errors() -> Column:
    """Array of messages; empty for a fully valid event. Messages are fixed values."""
    checks = [
        F.when(F.col(path).isNull(), F.lit(f"Required field '{path}' is None.")) for path in REQUIRED_FIELDS
    ]
    severity = F.col("severity_id")
    checks.append(
        F.when(~severity.between(0, 6), F.format_string("severity_id %d is out of range 0–6.", severity))
    )
    for path in ("src_endpoint.ip", "dst_endpoint.ip"):
        checks.append(
            F.when(
                ~is_ip(F.col(path)),
                F.format_string(f"Field '{path}' value '%s' is not a valid IPv4 or IPv6 address.", path),
            )
        )
    for path in ("src_endpoint.port", "dst_endpoint.port"):
        checks.append(
            F.when(
                ~F.col(path).between(0, 65535),
                F.format_string(f"Field '{path}' value '%d' is not in range 0–65535.", path),
            )
        )
    return F.array_compact(F.array(*checks))
