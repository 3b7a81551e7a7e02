"""Raw log lines as a DataFrame.

Every line carries where it came from (``file_path``, ``block_start``) and a
``seq`` that grows along the file within one block. A block is one input split,
so per-block work stays bounded however large the file is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.text import strip
from tidewatch.session import settled

POSITION = ["file_path", "block_start"]

# Line ends besides \r and \n that a text upload is split on.
_EXTRA_LINE_ENDS = "[\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"


def raw_text(spark: SparkSession, paths, line_sep: str | None = None) -> DataFrame:
    reader = spark.read
    if line_sep is not None:
        reader = reader.option("lineSep", line_sep)
    return reader.text(paths).select(
        "value",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
    )


def number_lines(lines: DataFrame) -> DataFrame:
    """Add ``seq``; meaningful only for comparing lines of one block in one scan."""
    return lines.withColumn("seq", F.monotonically_increasing_id())


def _latin1(value):
    return F.decode(value.cast("binary"), "ISO-8859-1")


def decode_files(lines: DataFrame) -> DataFrame:
    """Read a file that is not valid UTF-8 anywhere as latin-1 throughout.

    One narrow pass finds such files; unless there are none, lines are joined with them by path.
    """
    broken = settled(lines.where(~F.is_valid_utf8("value")).select("file_path").distinct(), "broken-files")
    if broken.isEmpty():
        return lines
    marked = lines.join(broken.withColumn("_broken", F.lit(True)), "file_path", "left")
    value = F.when(F.col("_broken"), _latin1(F.col("value"))).otherwise(F.col("value"))
    return marked.withColumn("value", value).drop("_broken")


def decode_lines(lines: DataFrame) -> DataFrame:
    """Cheaper variant for streams: decide per line instead of per file."""
    value = F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(_latin1(F.col("value")))
    return lines.withColumn("value", value)


def split_lines(lines: DataFrame) -> DataFrame:
    """Apply the rarer line ends and drop blank lines."""
    parts = F.when(F.col("value").rlike(_EXTRA_LINE_ENDS), F.split("value", _EXTRA_LINE_ENDS)).otherwise(
        F.array("value")
    )
    others = [c for c in lines.columns if c != "value"]
    return lines.select(F.explode(parts).alias("value"), *others).where(strip(F.col("value")) != "")


def read_lines(spark: SparkSession, paths, encoding: str = "file") -> DataFrame:
    """Non-blank lines. ``encoding``: "file" (UTF-8, else latin-1, per file), "line", or "utf-8"."""
    lines = raw_text(spark, paths)
    if encoding == "file":
        lines = decode_files(lines)
    elif encoding == "line":
        lines = decode_lines(lines)
    elif encoding != "utf-8":
        raise ValueError(f"encoding must be 'file', 'line' or 'utf-8', got {encoding!r}")
    return number_lines(split_lines(lines))


RECORD_END = "</Event>"


def read_xml_records(spark: SparkSession, paths) -> DataFrame:
    """One row per ``<Event>…</Event>``, however the records are laid out in the file."""
    return number_lines(xml_records(raw_text(spark, paths, line_sep=RECORD_END)))


# What may stand around records: a declaration and the tags of a list of events.
_WRAPPING = r"^\s*(<\?xml[^>]*\?>)?\s*(</?Events(\s[^>]*)?>)*\s*$"


def xml_records(records: DataFrame) -> DataFrame:
    """Whole records from text that was read with ``RECORD_END`` as line separator, in batch or as a stream.

    With the closing tag as separator large files still split. Other text before an opening tag or after the last record is
    kept as records of their own, one for each line that is not blank; they fail to parse and so reach the quarantine.
    """
    start = F.regexp_instr("value", F.lit(r"<Event[\s>]"))
    others = [c for c in records.columns if c != "value"]
    placed = records.where(strip(F.col("value")) != "").withColumn("_start", start)
    before = F.when(F.col("_start") > 0, F.expr("substr(value, 1, _start - 1)")).otherwise(F.col("value"))
    stray = F.filter(F.split(before, r"\r?\n"), lambda line: (strip(line) != "") & ~line.rlike(_WRAPPING))
    record = F.when(F.col("_start") > 0, F.concat(F.expr("substr(value, _start)"), F.lit(RECORD_END)))
    return placed.select(F.explode(F.concat(stray, F.array_compact(F.array(record)))).alias("value"), *others)
