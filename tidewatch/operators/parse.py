"""Log lines to raw fields.

Every parser takes a DataFrame with a text column ``value`` and adds ``is_parsed``
and ``raw``: a struct (fixed layouts) or a map (self-describing layouts) of text
fields, null where the line does not parse. A line's regular expression runs once; its groups
are joined by a control character and split, instead of one match per field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.errors import UnregisteredFormatError
from tidewatch.functions.text import blank_to_null, pinned, strip
from tidewatch.session import settled
from tidewatch.sources.lines import POSITION

# ---------------------------------------------------------------------------
# Log layouts.
# ---------------------------------------------------------------------------
ZEEK_FIELDS = (
    "ts uid id.orig_h id.orig_p id.resp_h id.resp_p proto service duration orig_bytes resp_bytes "
    "conn_state local_orig local_resp missed_bytes history orig_pkts orig_ip_bytes resp_pkts "
    "resp_ip_bytes tunnel_parents"
).split()

SYSLOG_FIELDS = ["priority", "month", "day", "time", "hostname", "process", "pid", "message"]
SYSLOG_PATTERN = (
    r"^(?:<(\d+)>)?([A-Za-z]{3})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+(\S+)\s+([^:\[]+)(?:\[(\d+)\])?:\s+(.+)$"
)

APACHE_FIELDS = ["client_ip", "ident", "user", "time", "request", "status", "bytes", "referer", "user_agent"]
APACHE_PATTERN = (
    r'^(\S+)\s+(\S+)\s+(\S+)\s+\[([^\]]+)\]\s+"([^"]*)"\s+(\d{3})\s+(\S+)'
    r'(?:\s+("[^"]*")\s+("[^"]*"))?\s*$'
)

EVENT_XML_NAMESPACE = "http://schemas.microsoft.com/win/2004/08/events/event"
# ------------------------------------------------------- end of fixed values

# Unix line ends and Unicode classes: what "." and "\s" mean for the line formats.
_FLAGS = "(?dU)"
_MARK = "\x01"


def _with_groups(lines: DataFrame, pattern: str, count: int) -> DataFrame:
    """Add ``is_parsed`` and ``_g``, all groups of a whole-line pattern.

    The steps are separate projections, so the match is computed once per line.
    Lines that hold the mark themselves take one match per group instead.
    """
    pattern = _FLAGS + pattern
    text = F.col("_t")
    has_mark = F.contains(text, F.lit(_MARK))
    one_by_one = F.array(*[F.regexp_extract(text, pattern, i) for i in range(1, count + 1)])
    matched = F.when(has_mark, text.rlike(pattern)).otherwise(F.size("_m") == count)
    joined = F.regexp_replace(text, pattern, _MARK.join(f"${i}" for i in range(1, count + 1)))
    return (
        lines.withColumn("_t", strip(F.col("value")))
        .withColumn("_m", F.split(joined, _MARK))
        .withColumn("is_parsed", pinned(F.coalesce(matched, F.lit(False))))
        .withColumn("_g", F.when(has_mark, one_by_one).otherwise(F.col("_m")))
        .drop("_t", "_m")
    )


def parse_syslog(lines: DataFrame) -> DataFrame:
    """RFC 3164 lines; priority and pid are optional."""
    split = _with_groups(lines, SYSLOG_PATTERN, len(SYSLOG_FIELDS))
    part = {name: F.get(F.col("_g"), F.lit(i)) for i, name in enumerate(SYSLOG_FIELDS)}
    part["priority"] = blank_to_null(part["priority"])
    part["pid"] = blank_to_null(part["pid"])
    part["process"] = strip(part["process"])
    raw = F.struct(*[part[name].alias(name) for name in SYSLOG_FIELDS])
    return split.withColumn("raw", F.when(F.col("is_parsed"), raw)).drop("_g")


def parse_apache(lines: DataFrame) -> DataFrame:
    """Common and combined access-log lines; "-" is null except in time and status."""
    split = _with_groups(lines, APACHE_PATTERN, len(APACHE_FIELDS))
    split = split.withColumn("_request", F.split(F.get(F.col("_g"), F.lit(4)), " ", 3))
    part = {name: F.get(F.col("_g"), F.lit(i)) for i, name in enumerate(APACHE_FIELDS)}

    def dash_to_null(c: Column) -> Column:
        return F.nullif(c, F.lit("-"))

    def unquote(c: Column) -> Column:
        """Groups keep their quotes, so an absent group differs from an empty one."""
        return dash_to_null(F.when(c != "", c.substr(F.lit(2), F.length(c) - 2)))

    raw = F.struct(
        dash_to_null(part["client_ip"]).alias("client_ip"),
        dash_to_null(part["ident"]).alias("ident"),
        dash_to_null(part["user"]).alias("user"),
        part["time"].alias("time"),
        blank_to_null(F.get(F.col("_request"), F.lit(0))).alias("method"),
        F.get(F.col("_request"), F.lit(1)).alias("uri"),
        F.get(F.col("_request"), F.lit(2)).alias("protocol"),
        part["status"].alias("status"),
        dash_to_null(part["bytes"]).alias("bytes"),
        unquote(part["referer"]).alias("referer"),
        unquote(part["user_agent"]).alias("user_agent"),
    )
    return split.withColumn("raw", F.when(F.col("is_parsed"), raw)).drop("_g", "_request")


# -- Zeek --------------------------------------------------------------------


def _zeek_parts() -> Column:
    return F.split(strip(F.col("value")), "\t")


def _is_data() -> Column:
    text = strip(F.col("value"))
    return (text != "") & ~F.startswith(text, F.lit("#"))


def _zeek_fixed(lines: DataFrame, fields: list[str]) -> DataFrame:
    """All lines share one column list, so fields are plain array positions."""
    names = list(dict.fromkeys(fields))
    last = {name: i for i, name in enumerate(fields)}  # a repeated name keeps its last value
    split = lines.withColumn("_p", F.when(_is_data(), _zeek_parts()))
    raw = F.struct(*[F.nullif(F.get(F.col("_p"), F.lit(last[n])), F.lit("-")).alias(n) for n in names])
    fits = F.coalesce(F.size("_p") == len(fields), F.lit(False))
    return split.withColumn("is_parsed", pinned(fits)).withColumn("raw", F.when(F.col("is_parsed"), raw)).drop("_p")


def _zeek_mapped(lines: DataFrame) -> DataFrame:
    """Lines carry their own column list in ``_fields``; a list that repeats a name takes the slower way."""
    split = lines.withColumn("_p", F.when(_is_data(), _zeek_parts()))
    fits = F.coalesce(F.size("_p") == F.size("_fields"), F.lit(False))
    unique = F.size(F.array_distinct("_fields")) == F.size("_fields")
    values = F.transform("_p", lambda v: F.nullif(v, F.lit("-")))
    pairs = F.zip_with("_fields", values, lambda k, v: F.struct(k.alias("k"), v.alias("v")))
    judged = split.withColumn("is_parsed", pinned(fits)).withColumn("_unique", unique)
    mapped = _map_last_wins(judged.withColumn("_pairs", F.when(F.col("is_parsed") & ~F.col("_unique"), pairs)))
    direct = F.when(F.col("is_parsed") & F.col("_unique"), F.map_from_arrays("_fields", values))
    return mapped.withColumn("raw", F.coalesce(direct, "raw")).drop("_p", "_fields", "_unique")


def _map_last_wins(rows: DataFrame) -> DataFrame:
    """``raw``, a map, from the (k, v) ``_pairs`` of parsed rows; a later value replaces an earlier one."""
    pairs, keys = F.col("_pairs"), F.col("_keys")
    last = F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"])
    values = F.when(F.size(keys) == F.size(pairs), F.transform(pairs, lambda p: p["v"])).otherwise(last)
    return (
        rows.withColumn("_keys", F.array_distinct(F.transform(pairs, lambda p: p["k"])))
        .withColumn("raw", F.when(F.col("is_parsed"), F.map_from_arrays(keys, values)))
        .drop("_pairs", "_keys")
    )


def _zeek_header() -> Column:
    """The column list of a ``#fields`` line, else null."""
    text = strip(F.col("value"))
    parts = F.split(text, "\t")
    return F.when(F.startswith(text, F.lit("#fields")) & F.contains(text, F.lit("\t")), F.slice(parts, F.lit(2), F.size(parts)))


def zeek_header_blocks(lines: DataFrame) -> DataFrame:
    """Per input block: the ``#fields`` header in force at its first data line.

    ``mixed`` marks blocks with a header after data, where one header does not
    hold for the whole block. The scan is map-side aggregated to one row per block.
    """
    marked = lines.select(*POSITION, "seq", _zeek_header().alias("h"), _is_data().alias("is_data")).where(
        F.col("h").isNotNull() | F.col("is_data")
    )
    blocks = marked.groupBy(*POSITION).agg(
        F.min(F.when(F.col("is_data"), F.col("seq"))).alias("first_data"),
        F.max_by("h", F.when(F.col("h").isNotNull(), F.col("seq"))).alias("last_header"),
        F.max(F.when(F.col("h").isNotNull(), F.col("seq"))).alias("last_header_at"),
    )
    earlier = W.partitionBy("file_path").orderBy("block_start").rowsBetween(W.unboundedPreceding, -1)
    carried = F.last("last_header", ignorenulls=True).over(earlier)
    default = F.array(*[F.lit(name) for name in ZEEK_FIELDS])
    headers_lead = F.col("last_header_at") < F.col("first_data")
    inherited = F.coalesce(carried, default)
    return blocks.select(
        *POSITION,
        F.col("first_data").isNotNull().alias("has_data"),
        F.when(headers_lead, F.col("last_header")).otherwise(inherited).alias("fields"),
        inherited.alias("inherited"),
        (F.coalesce(F.col("last_header_at") > F.col("first_data"), F.lit(False))).alias("mixed"),
    )


def _zeek_file_layouts(blocks: DataFrame) -> DataFrame:
    """Per file with data: its column list, and whether that list changes between data lines."""
    return (
        blocks.where("has_data")
        .groupBy("file_path")
        .agg(
            F.min("fields").alias("fields"),
            (F.bool_or("mixed") | (F.min("fields") != F.max("fields"))).alias("changes"),
        )
    )


def _zeek_in_order(lines: DataFrame) -> DataFrame:
    """Add ``_fields`` to lines of files whose column list changes between data lines.

    Positions are only compared within one stored copy of these lines, so it does
    not matter how the input would be split the next time it is read.
    """
    stored = settled(lines, "zeek-lines")
    blocks = settled(zeek_header_blocks(stored), "zeek-headers")
    steady = stored.join(blocks.where("NOT mixed").select(*POSITION, F.col("fields").alias("_fields")), POSITION)
    so_far = W.partitionBy(*POSITION).orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    mixed = stored.join(blocks.where("mixed").select(*POSITION, F.col("inherited").alias("_inherited")), POSITION)
    ordered = mixed.withColumn("_fields", F.coalesce(F.last(_zeek_header(), ignorenulls=True).over(so_far), "_inherited"))
    columns = [*lines.columns, "_fields"]
    return steady.select(*columns).unionByName(ordered.select(*columns))


def parse_zeek(lines: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Tab-separated Zeek lines; "-" is null.

    With ``fields`` the column list is given. Otherwise ``#fields`` lines set it
    for the lines that follow in the same file, and the conn.log list holds until
    the first one. A narrow first pass finds the list of each file. If one list
    holds everywhere, as in rotated logs, no join is needed; else lines are
    matched to the list of their file. Files whose list changes between data lines
    are stored first and put in order from that copy. A data line of a file that
    the first pass has not seen is an error.
    """
    if fields is not None:
        return _zeek_fixed(lines, list(fields))
    files = settled(_zeek_file_layouts(zeek_header_blocks(lines)), "zeek-files")
    shape = files.agg(
        F.max("fields").alias("fields"),
        F.count_distinct("fields").alias("layouts"),
        F.coalesce(F.bool_or("changes"), F.lit(False)).alias("changes"),
    ).first()
    if shape.layouts == 0:
        return _zeek_fixed(lines, ZEEK_FIELDS)
    if shape.layouts == 1 and not shape.changes:
        return _zeek_fixed(lines, shape.fields)
    columns = [*lines.columns, "_fields"]
    known = files.select("file_path", F.col("fields").alias("_known"), "changes")
    unseen = F.raise_error(F.concat(F.lit("no column list for the lines of "), F.col("file_path"))).cast("array<string>")
    found = F.when(F.col("_known").isNotNull(), F.col("_known")).when(_is_data(), unseen)
    matched = lines.join(known, "file_path", "left").where("NOT coalesce(changes, false)").withColumn("_fields", found).select(*columns)
    if not shape.changes:
        return _zeek_mapped(matched)
    changing = lines.join(files.where("changes").select("file_path"), "file_path", "left_semi")
    return _zeek_mapped(matched.unionByName(_zeek_in_order(changing).select(*columns)))


# -- Windows event XML --------------------------------------------------------

_EVENT_XML = (
    "System struct<EventID: struct<_VALUE: string, _Qualifiers: string>, "
    "TimeCreated: struct<_SystemTime: string, _VALUE: string>, Computer: string, Channel: string>, "
    "EventData struct<Data: array<struct<_Name: string, _VALUE: string>>>"
)


def parse_evtx(records: DataFrame) -> DataFrame:
    """Event XML, one record per row. Named EventData entries become fields of their own."""
    options = {"mode": "PERMISSIVE", "ignoreNamespace": "true", "ignoreSurroundingSpaces": "false"}
    text = strip(F.col("value"))
    is_event = F.contains(text, F.lit(EVENT_XML_NAMESPACE))
    parsed = records.withColumn("_x", F.when(is_event, F.from_xml(text, _EVENT_XML, options)))
    system = F.col("_x.System")

    def pair(name: Column, value: Column) -> Column:
        return F.struct(name.alias("k"), blank_to_null(value).alias("v"))

    fixed = F.array(
        pair(F.lit("EventID"), system["EventID"]["_VALUE"]),
        pair(F.lit("TimeCreated"), system["TimeCreated"]["_SystemTime"]),
        pair(F.lit("Computer"), system["Computer"]),
        pair(F.lit("Channel"), system["Channel"]),
    )
    named = F.filter(F.col("_x.EventData.Data"), lambda d: F.coalesce(d["_Name"], F.lit("")) != "")
    pairs = F.concat(fixed, F.coalesce(F.transform(named, lambda d: pair(d["_Name"], d["_VALUE"])), F.slice(fixed, 1, 0)))
    valid = F.coalesce(system["EventID"]["_VALUE"] != "", F.lit(False))
    return _map_last_wins(parsed.withColumn("is_parsed", pinned(valid)).withColumn("_pairs", pairs)).drop("_x")


def raw_field(schema: T.StructType, name: str) -> Column:
    """Field ``name`` of ``raw``, whichever form it has; null when the layout lacks it."""
    kind = schema["raw"].dataType
    if isinstance(kind, T.MapType):
        return F.try_element_at(F.col("raw"), F.lit(name))
    return F.col("raw").getField(name) if name in kind.names else F.lit(None).cast("string")


PARSERS = {"zeek": parse_zeek, "syslog": parse_syslog, "apache": parse_apache, "evtx": parse_evtx}
# Both the short label and the parser's own name are accepted.
FORMAT_ALIASES = {"zeek_conn": "zeek", "apache_access": "apache"}


def format_name(source_format: str) -> str:
    return FORMAT_ALIASES.get(source_format, source_format)


def parse(lines: DataFrame, source_format: str, **options) -> DataFrame:
    parser = PARSERS.get(format_name(source_format))
    if parser is None:
        raise UnregisteredFormatError(f"no parser for format '{source_format}'")
    return parser(lines, **options)


def split_parsed(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that parsed, rows that did not)."""
    return parsed.where("is_parsed"), parsed.where("NOT is_parsed")
