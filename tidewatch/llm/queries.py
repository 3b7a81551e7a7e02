"""The text operators as registered queries over whole tables."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import chat_format, collocations, decontaminate, jaccard_join, license_scan, line_quality, ngram_lm, pieces, quality_rules, suffix_dedup, token_align, token_files, toxicity
from tidewatch.llm.common import settle, table
from tidewatch.llm.oracles import ORACLES  # noqa: F401
from tidewatch.session import scratch_path

PIECE_MODEL = os.environ.get("PIECE_MODEL", public_tokenizers.path("piece_bpe_32k.model"))
TOKENIZER = os.environ.get("TOKENIZER_FILE", public_tokenizers.path("byte_bpe_50k.json"))
END_ID = 2


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip_digests(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = ngram_lm.held_out(F.col("doc_id").cast("bigint"))
    model = ngram_lm.train(docs.where(~out), scratch_path(spark, "lm"))
    return ngram_lm.score(docs, model).withColumn("held_out", out)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measured(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("runs", F.lit(0).cast("bigint"), lambda n, r: n + r["last"] - r["first"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        F.coalesce(toxicity.fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    manifest = token_files.write_token_files(docs, TOKENIZER, scratch_path(spark, "token-files"), END_ID)
    return token_files.read_token_files(spark, manifest)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id bigint, turn bigint, role string, text string")
    turns = settle(chat_format.format_turns(rows.unionByName(extra)), "chat-turns")
    return chat_format.read_back(turns).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.alignment_report(table(spark, sf_dir, "documents"), TOKENIZER, PIECE_MODEL, scratch_path(spark, "token-pairs"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), scratch_path(spark, "phrases"))


def op13_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = line_quality.fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(line_quality.fold(F.col("doc_id")) == line_quality.HELD_OUT, F.lit(False))
    return line_quality.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_lm_score": op2_lm_score,
    "op3_quality_rules": op3_quality_rules,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_license_scan": op5_license_scan,
    "op6_decontamination": op6_decontamination,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_token_files": op9_token_files,
    "op10_chat_format": op10_chat_format,
    "op11_token_align": op11_token_align,
    "op12_collocations": op12_collocations,
    "op13_line_quality": op13_line_quality,
}
