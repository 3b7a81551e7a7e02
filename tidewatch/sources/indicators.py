"""Indicator (IOC) lists: one value per line in text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.text import strip
from tidewatch.sources.lines import POSITION, number_lines, raw_text


def indicator_rows(lines: DataFrame, cap: int | None = None) -> DataFrame:
    """(file_path, ioc) of all usable lines, duplicates kept; with ``cap`` the first ``cap`` ones of each file.

    For a cap, counting per block first tells how many rows precede a block, so ranking
    needs no task that sees a whole file.
    """
    usable = lines.select(F.lower(strip(F.make_valid_utf8("value"))).alias("ioc"), *POSITION, "seq").where(
        (F.col("ioc") != "") & ~F.startswith("ioc", F.lit("#"))
    )
    if cap is None:
        return usable.select("file_path", "ioc")
    blocks = usable.groupBy(*POSITION).agg(F.count(F.lit(1)).alias("rows"))
    before = W.partitionBy("file_path").orderBy("block_start").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(*POSITION, F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before")).where(
        F.col("rows_before") < cap
    )
    in_block = F.row_number().over(W.partitionBy(*POSITION).orderBy("seq"))
    ranked = usable.join(blocks, POSITION).withColumn("rank", F.col("rows_before") + in_block)
    return ranked.where(F.col("rank") <= cap).select("file_path", "ioc")


def read_indicators(spark: SparkSession, paths, cap: int | None = None) -> DataFrame:
    return indicator_rows(number_lines(raw_text(spark, paths)), cap)


def loaded_per_file(rows: DataFrame) -> DataFrame:
    """How many rows each file contributed, before duplicates go."""
    return rows.groupBy("file_path").agg(F.count(F.lit(1)).alias("loaded"))


def distinct_indicators(rows: DataFrame) -> DataFrame:
    return rows.select("ioc").distinct()


def count_indicators(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_distinct("ioc").alias("ioc_count"))
