"""Quality rules: a table of thresholds compiled into one Spark projection.

Every measure is a whole number computed with built-in functions (no user functions, no
shuffle), and every rule compares a ratio of two measures with a lower and an upper bound, in
integers. Documents that break a rule are marked, and the broken rules are named.

Words are runs of characters other than space and ``\\t``-``\\r``. Words inside a 5-word
window that occurs twice or more count as repeated (windows are compared by a 64-bit hash).

Defined cases: null and empty texts have no words, all measures 0, and are not kept;
repeated rows get equal results; further columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 5

# Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in a is that it for on was be with as this by at are an from or not you have "
    "der die und den das von zu mit sich des auf für ist im dem nicht ein eine als auch es "
    "le la les de et des que en un une du dans pour qui pas sur est au par "
    "el los las y se del con no su por una para lo como más o"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= 1000 * measure / per <= high``, for documents of at least ``least_words`` words."""

    name: str
    measure: str
    per: str
    low: int | None = None
    high: int | None = None
    least_words: int = 1


RULES = (
    Rule("word_length", "word_chars", "n_words", low=2_000, high=15_000),
    Rule("symbols", "n_symbols", "n_words", high=100),
    Rule("stop_words", "n_stop_words", "n_words", low=20, least_words=50),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=400, least_words=50),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=900, least_words=50),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", high=300, least_words=50),
)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_bullet_lines", "n_ellipsis_lines")


def _stages(text: Column) -> list[dict[str, Column]]:
    """Columns in steps; each step reads the ones before (names with ``_q_`` are helpers)."""
    stop = [F.lit(w) for word in STOP_WORDS for w in (word, word.capitalize())]
    filled = F.filter(F.split("_q_text", "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    n = F.size("_q_words")
    keys = F.when(
        n >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), n - WINDOW),
            lambda i: F.xxhash64(*(F.get("_q_words", i + j) for j in range(WINDOW))),
        ),
    )
    ordered = F.when(
        F.size(F.array_distinct("_q_keys")) < F.size("_q_keys"),
        F.sort_array(F.arrays_zip(F.col("_q_keys").alias("key"), F.sequence(F.lit(0), F.size("_q_keys") - 1).alias("at"))),
    )
    # Neighbours with one key are windows that occur again; their starts in order, and the words they cover.
    m = F.size("_q_ordered")
    again = F.zip_with(
        F.slice("_q_ordered", F.lit(1), m - 1),
        F.slice("_q_ordered", F.lit(2), m - 1),
        lambda a, b: F.when(a["key"] == b["key"], F.array(a["at"], b["at"])).otherwise(F.array().cast("array<int>")),
    )
    covered = F.aggregate(
        F.sort_array(F.array_distinct(F.flatten(again))),
        F.struct(F.lit(0).alias("total"), F.lit(0).alias("end")),
        lambda acc, at: F.struct(
            (acc["total"] + at + WINDOW - F.greatest(at, acc["end"])).alias("total"), (at + WINDOW).alias("end")
        ),
        lambda acc: acc["total"],
    )
    big = lambda c: c.cast("bigint")
    return [
        {"_q_text": F.coalesce(text.cast("string"), F.lit(""))},
        {"_q_words": F.array_remove(F.split("_q_text", r"[ \t-\r]+"), ""), "_q_lines": filled},
        {"_q_keys": keys},
        {"_q_ordered": ordered},
        {
            "n_words": big(n),
            "word_chars": big(F.length(F.array_join("_q_words", ""))),
            "n_symbols": big(F.regexp_count("_q_text", F.lit(r"[#*$%&|<>]"))),
            "n_dup_lines": big(F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))),
            "n_repeat_words": big(F.when(F.col("_q_ordered").isNull(), 0).otherwise(covered)),
            "n_lines": big(F.size("_q_lines")),
            "n_stop_words": big(F.size(F.filter("_q_words", lambda w: w.isin(*stop)))),
            "n_bullet_lines": big(F.size(F.filter("_q_lines", lambda x: x.rlike(r"^\s*[-*•]\s")))),
            "n_ellipsis_lines": big(F.size(F.filter("_q_lines", lambda x: x.rlike(r"(\.\.\.|…)\s*$")))),
        },
    ]


def broken(rule: Rule) -> Column:
    """Whether the measures break the rule."""
    value, per = 1000 * F.col(rule.measure), F.col(rule.per)
    out = F.lit(False)
    if rule.low is not None:
        out = out | (value < rule.low * per)
    if rule.high is not None:
        out = out | (value > rule.high * per)
    return out & (F.col("n_words") >= rule.least_words)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def measured(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measures, base_failed, the names of broken rules, and kept."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("_q_given"))
    for step in _stages(F.col("_q_given")):
        rows = rows.select("doc_id", *(c for c in rows.columns if c.startswith("_q_") and c not in step), *(v.alias(k) for k, v in step.items()))
    names = F.array_compact(F.array(*(F.when(broken(r), F.lit(r.name)) for r in rules)))
    return rows.select(
        "doc_id",
        *MEASURES,
        base_failed().alias("base_failed"),
        names.alias("broken_rules"),
    ).withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))
