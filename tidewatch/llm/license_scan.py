"""License scans by diagonal voting, with built-in functions and joins only.

All rolling word k-grams of a text are hashed and joined with the positions of the k-grams
of the templates. A hit votes for its diagonal (place in the text less place in the
template); votes are counted per document, template and diagonal; neighbouring diagonals
(small insertions or deletions) are merged; and a merged span counts if the words that
agree, compared as words, make up enough of the template.

The template table is a fixed list of some hundred words, so it is broadcast. A text
position is looked at further only if its two-word gram begins a template gram, which
leaves few rows to join. Votes are grouped by document and never by template alone, so a
license line that many documents have is no hot key.

Defined cases: null and empty texts have no words and no places; repeated rows (equal
doc_id and text) get equal results each; a null doc_id is kept as one; further columns
are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidewatch.llm.common import settle

GRAM = 4
NEAR = 3
MIN_COVERAGE = 0.6


@dataclass(frozen=True)
class Template:
    """``base`` templates are phrases that count wherever they stand in full."""

    label: str
    text: str
    base: bool = False


# Names and notices of common licenses.
TEMPLATES = (
    Template("mit", "mit license", base=True),
    Template("apache", "apache license", base=True),
    Template("gpl", "general public license", base=True),
    Template("bsd", "bsd license"),
    Template("cc-by", "licensed under cc by"),
    Template("cc-by", "creative commons attribution"),
    Template("mpl", "mozilla public license"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files to deal in the software without restriction including without limitation the rights to use "
        "copy modify merge publish distribute sublicense and or sell copies of the software",
    ),
    Template(
        "apache",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    ),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
        "as published by the free software foundation",
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met",
    ),
)


def _hash(words: list[Column]) -> Column:
    return F.xxhash64(*words)


def _grams(template: Template) -> tuple[int, list[list[str]]]:
    words = re.findall(r"[0-9a-z]+", template.text)
    k = min(GRAM, len(words))
    return k, [words[i : i + k] for i in range(len(words) - k + 1)]


def template_positions(spark: SparkSession, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """template, label, base, n_template (words), k, place, gram."""
    rows = []
    for number, t in enumerate(templates):
        k, grams = _grams(t)
        if k < 2:
            raise ValueError("a template needs two words")
        rows += [(number, t.label, t.base, len(grams) + k - 1, k, place, gram) for place, gram in enumerate(grams)]
    return spark.createDataFrame(rows, "template int, label string, base boolean, n_template int, k int, place int, gram array<string>")


def lowered(text: Column) -> Column:
    """A-Z to lower case, other characters as they are."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


def _text_hits(docs: DataFrame, templates: tuple[Template, ...]) -> DataFrame:
    """doc_id, row_key, n_words, hits: the places whose first two words begin a template gram."""
    spark = docs.sparkSession
    starts = template_positions(spark, templates).select(_hash([F.get("gram", F.lit(0)), F.get("gram", F.lit(1))]).alias("h")).distinct()
    wanted = [r["h"] for r in starts.collect()]  # a value for each template position at most
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("_l_text"))
    rows = rows.select("doc_id", F.xxhash64("_l_text").alias("row_key"), lowered(F.col("_l_text")).alias("_l_low"))
    rows = rows.select("doc_id", "row_key", F.array_remove(F.split("_l_low", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "").alias("_l_words"))
    word = lambda i, j: F.get("_l_words", i + j)
    places = F.when(
        F.size("_l_words") >= 2,
        F.filter(F.sequence(F.lit(0), F.size("_l_words") - 2), lambda i: _hash([word(i, 0), word(i, 1)]).isin(wanted)),
    )
    return rows.select("doc_id", "row_key", F.size("_l_words").alias("n_words"), F.transform(
        places, lambda i: F.struct(i.alias("at"), F.slice("_l_words", i + 1, F.lit(GRAM)).alias("words"))
    ).alias("hits"))


def spans(hits: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Verified places: doc_id, row_key, label, base, first_word, last_word (of the span), coverage."""
    spark = hits.sparkSession
    kinds = sorted({_grams(t)[0] for t in templates})
    grams = (
        hits.select("doc_id", "row_key", F.explode("hits").alias("hit"))
        .select("doc_id", "row_key", F.col("hit.at").alias("at"), F.col("hit.words").alias("words"), F.explode(F.array(*map(F.lit, kinds))).alias("k"))
        .where(F.size("words") >= F.col("k"))
        .withColumn("text_gram", F.slice("words", F.lit(1), F.col("k")))
        .withColumn("h", F.xxhash64("text_gram"))
    )
    table = template_positions(spark, templates).withColumn("h", F.xxhash64("gram"))
    key = ["doc_id", "row_key", "template", "label", "base", "n_template", "k"]
    votes = (
        grams.join(F.broadcast(table), ["k", "h"])
        .where(F.col("text_gram") == F.col("gram"))
        .groupBy(*key, (F.col("at") - F.col("place")).alias("diagonal"))
        .agg(F.collect_set("place").alias("places"), F.min("at").alias("first"), F.max("at").alias("last"))
    )
    # A template that occurs again further on is another diagonal far away; near ones are one place.
    w = Window.partitionBy("doc_id", "row_key", "template").orderBy("diagonal")
    start = F.when(F.col("base"), True).otherwise(F.coalesce(F.col("diagonal") - F.lag("diagonal").over(w) > NEAR, F.lit(True)))
    merged = (
        votes.withColumn("group", F.sum(start.cast("int")).over(w))
        .groupBy(*key, "group")
        .agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.min("first").alias("first"), F.max("last").alias("last"))
    )
    # Words of the template that agree: the union of the grams that hit.
    agreeing = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("k") - 1)))))
    return (
        merged.withColumn("coverage", agreeing / F.col("n_template"))
        .where(F.col("coverage") >= F.when(F.col("base"), 1.0).otherwise(MIN_COVERAGE))
        .select("doc_id", "row_key", "label", "base", F.col("first").cast("bigint").alias("first_word"), (F.col("last") + F.col("k") - 1).cast("bigint").alias("last_word"), "coverage")
    )


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; one row for each document row."""
    hits = settle(_text_hits(docs, templates), "license-hits")
    labels = lambda rows: F.array_join(F.sort_array(F.collect_set(rows)), ",")
    base = F.col("base")
    found = (
        spans(hits.where(F.size("hits") > 0), templates)
        .groupBy(F.col("doc_id").alias("f_id"), F.col("row_key").alias("f_key"))
        .agg(
            F.count_if(base).alias("n_base"),
            F.min(F.when(base, F.col("first_word"))).alias("first_word"),
            F.max(F.when(base, F.col("first_word"))).alias("last_word"),
            labels(F.when(base, F.col("label"))).alias("base_labels"),
            labels(F.col("label")).alias("labels"),
            F.max("coverage").alias("score"),
        )
    )
    rows = hits.select("doc_id", "row_key", F.col("n_words").cast("bigint").alias("n_words"))
    joined = rows.join(found, rows.doc_id.eqNullSafe(found.f_id) & (rows.row_key == found.f_key), "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
