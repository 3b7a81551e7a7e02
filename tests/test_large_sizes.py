"""What must not grow with the input: work done twice, filters that are full, files written by one task."""

from pyspark.sql import functions as F

from tidewatch.functions import bloom
from tidewatch.operators import indicators as I
from tidewatch.testbed import engine_queries


def _events(spark, n):
    ip = F.concat(F.lit("10.0.0."), F.col("id").cast("string"))
    return spark.range(n).select(
        F.col("id").alias("event_id"),
        F.struct(ip.alias("ip")).alias("src_endpoint"),
        F.struct(F.lit(None).cast("string").alias("ip")).alias("dst_endpoint"),
        F.struct(F.lit("/X").alias("path")).alias("file"),
        F.struct(F.struct(F.lit("Ann").alias("name")).alias("user")).alias("actor"),
    )


def test_a_list_too_long_for_a_filter_gets_none(spark):
    wanted = spark.range(5_000).select(F.concat(F.lit("10.0.0."), (F.col("id") * 3).cast("string")).alias("ioc"))
    assert bloom.build_if_useful(wanted, "ioc", "bits", 1 << 16) is not None
    large = I.LargeList(wanted, 0, most_bits=1 << 12)
    assert large.filter is None
    events = _events(spark, 100)
    assert {r.event_id: list(r.ioc_matches) for r in large.hits(events).collect()} == {i: [f"10.0.0.{i}"] for i in range(0, 100, 3)}
    marked = {r.event_id: list(r.ioc_matches) for r in large.mark(events).collect()}
    assert marked == {i: [] if i % 3 else [f"10.0.0.{i}"] for i in range(100)}


def test_events_without_any_value_are_kept(spark):
    large = I.LargeList(spark.createDataFrame([("ann",)] + [(f"v{i}",) for i in range(2_000)], "ioc string"), 0, most_bits=1 << 12)
    bare = _events(spark, 2).withColumn("actor", F.lit(None).cast("struct<user:struct<name:string>>")).withColumn("file", F.lit(None).cast("struct<path:string>"))
    bare = bare.withColumn("src_endpoint", F.lit(None).cast("struct<ip:string>"))
    assert [list(r.ioc_matches) for r in large.mark(bare).collect()] == [[], []]


def test_a_long_list_is_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def value(n):
        made.add(1)
        return f"v{n}"

    listed = spark.range(3_000).select(value.asNondeterministic()("id").alias("ioc"))
    assert I.indicator_hits(_events(spark, 3), listed, max_bytes=16).collect() == []
    assert made.value == 3_000


def test_no_shuffle_before_files_are_written(spark, tmp_path, monkeypatch):
    docs = spark.range(600).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("café "), F.repeat(F.col("id").cast("string"), 50)).alias("text"), F.when(F.col("id") % 2 == 0, "en").otherwise("fr").alias("lang")
    )
    docs.repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    read, paths = engine_queries.read_lines, []
    monkeypatch.setattr(engine_queries, "read_lines", lambda spark, given: paths.extend(given) or read(spark, given))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = engine_queries.read_latin1_files(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 600
    for path in paths:
        files = spark.read.text(path).select(F.input_file_name()).distinct().count()
        assert files >= 6
