"""Search of very many keywords: against brute force, shared prefixes, odd characters, and how much it shuffles."""

import random

from pyspark.sql import functions as F

from tidewatch.functions import bloom
from tidewatch.operators import keyword_search as K
from tidewatch.operators import rules as R


def hits(spark, texts, words):
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    keywords = spark.createDataFrame([(w,) for w in words], "keyword string")
    return {r.text: list(r.hits) for r in K.find(rows, keywords).collect()}


def test_find_against_brute_force(spark):
    rng = random.Random(3)
    letters = ["a", "b", ".", "1", " ", "é", "\n", "𝄞", "?"]
    texts = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(90))) for _ in range(250)})
    words = {"".join(rng.choice(letters) for _ in range(rng.choice([1, 1, 2, 3, 4, 5, 8, 9]))) for _ in range(150)}
    words |= {t[i : i + n] for t in rng.sample(texts, 60) for i in (0, 5) for n in (7, 8, 16, 33, 40) if len(t) >= i + n}
    assert hits(spark, texts, words) == {t: sorted((w for w in words if w in t), key=lambda w: w.encode()) for t in texts}


def test_one_prefix_makes_few_candidates(spark):
    """100,000 keywords that all begin alike: candidates stay near the number of hits."""
    words = spark.range(100_000).select(F.concat(F.lit("10.0.0.0/"), F.col("id").cast("string"), F.lit(" port")).alias("keyword"))
    texts = spark.range(2_000).select(F.concat(F.lit("from 10.0.0.0/"), (F.col("id") * 131).cast("string"), F.lit(" port 22 to 10.0.0.0/1")).alias("text"))
    texts = texts.withColumn("text_id", F.xxhash64("text"))
    filed = K.file_keywords(texts, words, [8, 16])
    assert filed.count() < 5_000  # keywords with a gram that no text has are gone
    met = K.candidates(texts, filed, [8, 16])
    found = {r.text: list(r.hits) for r in K.find(texts.select("text"), words).collect()}
    want = sum(i * 131 < 100_000 for i in range(2_000))
    assert sum(map(len, found.values())) == want
    assert met.count() < 4 * want


def test_empty_sides(spark):
    none = spark.createDataFrame([], "keyword string")
    rows = spark.createDataFrame([("some text",), (None,), ("",)], "text string")
    assert [list(r.hits) for r in K.find(rows, none).collect()] == [[], [], []]
    some = spark.createDataFrame([("some",), ("text",)], "keyword string")
    got = {r.text: list(r.hits) for r in K.find(rows, some).collect()}
    assert got == {"some text": ["some", "text"], None: [], "": []}
    assert K.find(rows.where("false"), some).collect() == []


def test_absent_keywords_leave_before_grams_are_shuffled(spark):
    """Far more grams than a filter of the former size held: only keywords that may occur are cut up."""
    words = spark.range(400_000).select(F.concat(F.lit("10.0.0."), F.col("id").cast("string"), F.lit(" host1")).alias("keyword"))
    texts = spark.range(3_000).select(F.concat(F.lit("a 10.0.0."), (F.col("id") % 50).cast("string"), F.lit(" host1 at "), (F.col("id") * 7919).cast("string")).alias("text"))
    have = K.text_bits(texts, [4, 8, 16])
    kept = K.may_occur(words, have)
    assert 50 <= kept.count() < 4_000
    found = K.find(texts, words).select(F.explode("hits").alias("w")).groupBy("w").count()
    assert {r["w"]: r["count"] for r in found.collect()} == {f"10.0.0.{i} host1": 60 for i in range(50)}


def test_long_texts_and_grams_over_pieces(spark, monkeypatch):
    monkeypatch.setattr(K, "_PLACES", 7)
    import pyarrow as pa

    texts = ["", "ab", "é" * 9, "x" * 40, "0123456789abcdefghij"]
    got = {size: 0 for size in (1, 2, 8, 16)}
    for size, rows, hashes in K._grams(pa.array(["cut"] + texts)[1:], [1, 2, 8, 16]):
        assert len(rows) == len(hashes)
        got[size] += len(rows)
    assert got == {n: sum(max(0, len(t.encode()) - n + 1) for t in texts) for n in got}


def test_rows_keep_their_columns_and_copies(spark):
    rows = spark.createDataFrame([(1, "needle here", 2), (2, "needle here", 3), (3, None, 4)], "text_id int, line string, hit int")
    words = spark.createDataFrame([("needle",)], "keyword string")
    got = R.with_keyword_hits(rows, words, text="line", literal_keywords=0)
    assert got.columns == ["text_id", "line", "hit", "hits"]
    assert sorted((r.text_id, list(r.hits)) for r in got.collect()) == [(1, ["needle"]), (2, ["needle"]), (3, [])]


def test_bloom_filter(spark):
    values = spark.range(5_000).select(F.concat(F.lit("v"), "id").alias("v")).unionByName(spark.createDataFrame([(None,), ("",)], "v string"))
    made = bloom.build(values, "v", "bloom-test")
    assert made.bits == 1 << 16
    assert values.where(made.may_contain(F.col("v"))).count() == 5_001
    others = spark.range(20_000).select(F.concat(F.lit("w"), "id").alias("v"))
    assert others.where(made.may_contain(F.col("v"))).count() < 400
    assert bloom.build(values, "v", "bloom-test", most_bits=1 << 13).bits == 1 << 13
    empty = bloom.build(values.where("false"), "v", "bloom-test")
    assert values.where(empty.may_contain(F.col("v"))).count() == 0
