"""Keyword rules: versions, confirmation, keyword extraction, matching, backtests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.text import pinned, strip
from tidewatch.operators import keyword_search
from tidewatch.session import settled

# -- versions ----------------------------------------------------------------


def latest_rules(submissions: DataFrame, confirmations: DataFrame | None = None, order: tuple[str, ...] = ("submitted_at",)) -> DataFrame:
    """Current state per rule out of all submissions.

    Every submission of a rule is a version, so the latest version number is the
    number of submissions. This is one aggregation that combines before the
    shuffle: a rule with very many versions does not end up in one sorted group.
    Submissions of one time are told apart by the further ``order`` columns, at last by their text.
    ``confirmations`` holds (rule_id, version, confirmed_at); only a confirmation
    of the latest version counts, because a new version clears it.
    """
    position = F.struct(*[F.col(c) for c in (*order, "yaml_content")])
    current = (
        submissions.groupBy("rule_id")
        .agg(
            F.max_by("yaml_content", position).alias("yaml_content"),
            F.count(F.lit(1)).cast("int").alias("version"),
            F.min("submitted_at").alias("created_at"),
        )
        .withColumn("sha256", F.sha2("yaml_content", 256))
    )
    if confirmations is None:
        return current.withColumn("analyst_confirmed", F.lit(False)).withColumn("confirmed_at", F.lit(None).cast("timestamp"))
    confirmed = confirmations.groupBy("rule_id", "version").agg(F.max("confirmed_at").alias("confirmed_at"))
    return current.join(confirmed, ["rule_id", "version"], "left").withColumn(
        "analyst_confirmed", F.col("confirmed_at").isNotNull()
    )


def number_versions(submissions: DataFrame, order: tuple[str, ...] = ("submitted_at",)) -> DataFrame:
    """All versions, numbered 1, 2, … per rule in submission order.

    Counts per rule and second give the offset of each second; within it rows are
    numbered, ties as in ``latest_rules``. A rule with very many versions is thus
    spread over its seconds.
    """
    slice_ = F.date_trunc("second", "submitted_at")
    sliced = submissions.withColumn("_slice", slice_)
    earlier = W.partitionBy("rule_id").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy("rule_id", "_slice")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("rule_id", "_slice", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    )
    within = F.row_number().over(W.partitionBy("rule_id", "_slice").orderBy(*order, "yaml_content"))
    return (
        sliced.withColumn("_n", within)
        .join(offsets, ["rule_id", "_slice"])
        .withColumn("version", (F.col("_before") + F.col("_n")).cast("int"))
        .withColumn("sha256", F.sha2("yaml_content", 256))
        .drop("_slice", "_n", "_before")
    )


def list_rules(rules: DataFrame, confirmed_only: bool = False) -> DataFrame:
    """Newest first."""
    chosen = rules.where("analyst_confirmed") if confirmed_only else rules
    return chosen.orderBy(F.col("created_at").desc(), "rule_id")


def rule_counts(rules: DataFrame) -> DataFrame:
    return rules.agg(
        F.count(F.lit(1)).alias("rules_stored"), F.count_if("analyst_confirmed").alias("rules_confirmed")
    )


def exports(rules: DataFrame) -> DataFrame:
    """(rule_id, version, exported, refused): the text of each rule whose latest version is confirmed; others are refused."""
    confirmed = F.coalesce(F.col("analyst_confirmed"), F.lit(False))
    return rules.select("rule_id", "version", F.when(confirmed, F.col("yaml_content")).alias("exported"), (~confirmed).alias("refused"))


# -- keywords ----------------------------------------------------------------

# How keywords are found in rule text when every list item counts.
_INLINE = r"(?dU)(?i)(?:keywords|value):\s+([^\n]+)"
_LIST_ITEM = r"(?dmU)^\s*-\s+([^\n]+)"
# Only items that stand under "keywords:" or "value:", and text on the same line.
_INLINE_STRICT = r"(?dm)(?i)^[ \t]*(?:-[ \t]+)?(?:keywords|value):[ \t]+(\S[^\n]*)"
_BLOCK_STRICT = r"(?dm)(?i)^[ \t]*(?:-[ \t]+)?(?:keywords|value):[ \t]*\n((?:[ \t]*-[ \t]+[^\n]+(?:\n|\z))+)"


def keywords(yaml: Column, compat: bool = False) -> Column:
    """Keywords of a rule text, in order.

    By default the items under ``keywords:``/``value:``. With ``compat`` any list
    item of the text counts, and a list right after ``keywords:`` also yields its
    first item with the dash in front.
    """
    if compat:
        found = F.concat(F.regexp_extract_all(yaml, F.lit(_INLINE), 1), F.regexp_extract_all(yaml, F.lit(_LIST_ITEM), 1))
    else:
        blocks = F.array_join(F.regexp_extract_all(yaml, F.lit(_BLOCK_STRICT), 1), "\n")
        found = F.concat(
            F.regexp_extract_all(yaml, F.lit(_INLINE_STRICT), 1), F.regexp_extract_all(blocks, F.lit(_LIST_ITEM), 1)
        )
    cleaned = F.transform(found, lambda k: F.btrim(strip(k), F.lit("'\"")))
    return F.filter(cleaned, lambda k: k != "")


def rule_keywords(rules: DataFrame, compat: bool = False) -> DataFrame:
    """(rule_id, keyword), one row per distinct lower-cased keyword of a rule."""
    return rules.select("rule_id", F.explode(keywords(F.col("yaml_content"), compat)).alias("keyword")).select(
        "rule_id", F.lower("keyword").alias("keyword")
    ).distinct()


# -- matching ----------------------------------------------------------------


def event_text(events: DataFrame, skip: tuple[str, ...] = ()) -> Column:
    """All non-null values of an event, lower-cased, joined by blanks in schema order."""

    def text(path: str, kind: T.DataType) -> list[Column]:
        if path in skip:
            return []
        if isinstance(kind, T.StructType):
            return [c for f in kind.fields for c in text(f"{path}.{f.name}", f.dataType)]
        column = F.col(path)
        if isinstance(kind, T.ArrayType):
            return [F.array_join(column, ", ")]
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return [F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")]
        return [column.cast("string")]

    parts = [c for f in events.schema.fields for c in text(f.name, f.dataType)]
    return F.lower(F.concat_ws(" ", *parts))


def matches_any(text: Column, words: list[str]) -> Column:
    """Whether any keyword occurs; one scan-side predicate, no join."""
    if not words:
        return F.lit(False)
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word.lower()))
    return found


def match_rule(events: DataFrame, yaml_content: str, compat: bool = False, skip: tuple[str, ...] = ()) -> DataFrame:
    """Add ``matched`` for one rule. Narrow the events down before, not after."""
    spark = events.sparkSession
    words = spark.range(1).select(keywords(F.lit(yaml_content), compat).alias("k")).first().k
    return events.withColumn("_text", event_text(events, skip)).withColumn(
        "matched", pinned(matches_any(F.col("_text"), words))
    ).drop("_text")


LITERAL_KEYWORDS = 128
_SALTS = 8


def with_keyword_hits(rows: DataFrame, words: DataFrame, text: str = "text", literal_keywords: int = LITERAL_KEYWORDS) -> DataFrame:
    """Add ``hits``: the sorted keywords that occur in column ``text``.

    A few keywords become literals of one expression. Larger sets of any size are searched
    through ``keyword_search.find``; equal texts are searched once and known by a hash (the text itself is
    compared when hits are joined back).
    """
    wanted = settled(words.select("keyword").where("keyword <> ''").distinct(), "keywords")
    listed = wanted.limit(literal_keywords + 1).collect()
    if len(listed) <= literal_keywords:
        found = [F.when(F.contains(F.col(text), F.lit(w)), F.lit(w)) for w in sorted(row.keyword for row in listed)]
        return rows.withColumn("hits", pinned(F.array_compact(F.array(*found).cast("array<string>"))))
    texts = settled(rows.select(F.col(text).alias("text")).distinct(), "keyword-texts")
    found = keyword_search.find(texts, wanted).where(F.size("hits") > 0)
    found = found.select(F.col("text").alias("_found_text"), F.xxhash64("text").alias("_found_id"), "hits")
    on = (F.xxhash64(F.col(text)) == F.col("_found_id")) & (F.col(text) == F.col("_found_text"))
    joined = rows.join(found, on, "left").drop("_found_text", "_found_id")
    return joined.withColumn("hits", F.coalesce("hits", F.array().cast("array<string>")))


def keyword_sets(texts: DataFrame, words: DataFrame, literal_keywords: int = LITERAL_KEYWORDS) -> DataFrame:
    """(hits, n): per set of keywords that occur together in a ``text``, how many rows have it; the empty set included."""
    count = F.count(F.lit(1)).alias("n")
    wanted = settled(words.select("keyword").where("keyword <> ''").distinct(), "keywords")
    if len(wanted.limit(literal_keywords + 1).collect()) <= literal_keywords:
        return with_keyword_hits(texts, wanted, literal_keywords=literal_keywords).groupBy("hits").agg(count)
    # Rows are counted by text first, so no hit is joined back to them.
    counted = settled(texts.groupBy("text").agg(count), "keyword-texts")
    return keyword_search.find(counted, wanted).groupBy("hits").agg(F.sum("n").alias("n"))


def backtest_rules(
    events: DataFrame, rules: DataFrame, compat: bool = False, skip: tuple[str, ...] = (), **search
) -> DataFrame:
    """(rule_id, match_count, total_events) for many rules over the same events.

    Events are first counted per set of keywords they contain, and rules with the
    same keywords are taken together. Only the distinct sets of both sides meet,
    on a shared keyword, and each pair counts once, as it is formed. ``search`` are options of
    ``keyword_sets``.
    """
    words = settled(rule_keywords(rules, compat), "rule-keywords")
    texts = events.select(event_text(events, skip).alias("text"))
    # One pass over the events: per set of keywords found how many events have it, the empty set included.
    seen = settled(keyword_sets(texts, words, **search), "keyword-sets")
    of_rule = words.groupBy("rule_id").agg(F.sort_array(F.collect_set("keyword")).alias("wanted"))
    # A set meets each set of wanted keywords once: at the first keyword, in order, that both have.
    # Frequent keywords are salted on the side of the events' sets and repeated on the rules' side.
    salts = F.array(*[F.lit(i) for i in range(_SALTS)])
    sets = seen.where(F.size("hits") > 0).select("hits", "n", F.pmod(F.xxhash64("hits"), F.lit(_SALTS)).cast("int").alias("salt"), F.explode("hits").alias("keyword"))
    asked = of_rule.select("wanted").distinct().select("wanted", F.explode("wanted").alias("keyword")).withColumn("salt", F.explode(salts))
    per_set = (
        asked.join(sets, ["keyword", "salt"])
        .where(F.element_at(F.array_intersect("wanted", "hits"), 1) == F.col("keyword"))
        .groupBy("wanted")
        .agg(F.sum("n").alias("match_count"))
    )
    per_rule = of_rule.join(per_set, "wanted").select("rule_id", "match_count")
    total = seen.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar()
    return rules.select("rule_id").join(per_rule, "rule_id", "left").select(
        "rule_id",
        F.coalesce("match_count", F.lit(0)).cast("bigint").alias("match_count"),
        total.alias("total_events"),
    )


def match_rate(matched: Column, total: Column) -> Column:
    return F.when(total > 0, F.format_string("%.1f%%", matched * 100.0 / total)).otherwise(F.lit("N/A"))
