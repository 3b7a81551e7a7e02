"""Which of very many keywords occur in which texts, by joins on grams.

A keyword of n bytes is looked at in grams of one size: the largest of ``GRAMS`` that fits. A gram is known by a 64-bit hash;
tasks compute the hashes of all places of a batch at once. First, sets of bits of bounded size hold the grams of the texts, a set for
each size: a keyword with a gram that no text has cannot occur and is dropped, before any of its grams is shuffled.
Grams are then counted in the texts and among the keywords that are left, and each of these is filed under the one of its grams that makes
the fewest candidates, so keywords that share a beginning (or any part) are told apart by what they do not share.

Texts are cut into the same grams, in time linear in their length. Bits of the filed grams drop those that no
keyword is filed under before anything is shuffled. What remains meets the filed keywords in one join, and each
candidate is verified against its text, so a collision of hashes or bits costs time only. Nothing but the bits is collected, and no
side is sent whole to every task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.bits import BitSet, build
from tidewatch.session import settled

GRAMS = (32, 16, 8, 4, 2, 1)
# Bytes whose grams are hashed at once, so a very long text takes no more memory.
_PLACES = 1 << 19
_BYTE_HASH = np.random.default_rng(1).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def _gram_size(word: Column) -> Column:
    size = F.lit(GRAMS[-1])
    for n in reversed(GRAMS[:-1]):
        size = F.when(F.octet_length(word) >= n, n).otherwise(size)
    return size


def _sizes(lengths: np.ndarray) -> np.ndarray:
    """The same for many lengths; 0 for none."""
    ascending = np.array((0, *sorted(GRAMS)))
    return ascending[np.searchsorted(ascending, lengths, "right") - 1]


def _grams(texts: pa.Array, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, rows, hashes) of all grams of the given sizes, some places at a time. A gram of 2n bytes is hashed from its halves."""
    binary = texts.cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary())
    if not len(binary) or binary.buffers()[2] is None:
        return
    kind = np.int32 if pa.types.is_binary(binary.type) else np.int64
    ends = np.frombuffer(binary.buffers()[1], kind)[binary.offset : binary.offset + len(binary) + 1].astype(np.int64)
    data = np.frombuffer(binary.buffers()[2], np.uint8)
    most = max(sizes)
    for a in range(int(ends[0]), int(ends[-1]), _PLACES):
        b = min(a + _PLACES, int(ends[-1]))
        rows = np.repeat(np.arange(len(binary)), np.diff(np.clip(ends, a, b)))
        left = ends[rows + 1] - np.arange(a, b)
        hashes, size = _BYTE_HASH[data[a : min(b + most - 1, int(ends[-1]))]], 1
        while True:
            if size in sizes:
                ok = np.flatnonzero(left[: len(hashes)] >= size)
                yield size, rows[ok], hashes[ok]
            if size == most or len(hashes) <= size:
                break
            halves = hashes[:-size] * np.uint64(0x9E3779B97F4A7C15) + (hashes[size:] ^ (hashes[size:] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            hashes, size = halves ^ (halves >> np.uint64(32)), size * 2


def _distinct(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, hashes) once each, hashes as Spark holds them."""
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.append(True, (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1]))[: len(rows)]
    return rows[new], hashes[new].view(np.int64)


def _over(batches: Iterator[pa.RecordBatch], name: str, sizes: list[int], of: Callable) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(name))
        for size, rows, hashes in _grams(column, sizes):
            if len(rows):
                yield from of(batch, size, rows, hashes)


def text_bits(texts: DataFrame, sizes: list[int]) -> dict[int, BitSet]:
    """The grams of the texts, by size."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        for batch in batches:
            for size, _, hashes in _grams(batch.column(0), sizes):
                yield size, hashes

    places = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    return build(texts.select("text"), hashed, places, sizes, probes=1)


def may_occur(words: DataFrame, have: dict[int, BitSet]) -> DataFrame:
    """The keywords all of whose grams some text may have, in every size that fits."""
    shared = words.sparkSession.sparkContext.broadcast(have)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            absent = np.zeros(batch.num_rows, bool)
            for size, rows, hashes in _grams(batch.column(0), list(shared.value)):
                absent[rows[~shared.value[size].has(hashes)]] = True
            yield batch.filter(pa.array(~absent))

    return words.select("keyword").mapInArrow(run, "keyword string")


def keyword_grams(words: DataFrame) -> DataFrame:
    """(keyword, gram) of all grams of each ``keyword`` in its own size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0)
            own = _sizes(np.asarray(pc.binary_length(words)))
            for size, rows, hashes in _grams(words, sorted(set(own.tolist()) - {0}) or [1]):
                mine = own[rows] == size
                rows, grams = _distinct(rows[mine], hashes[mine])
                yield pa.RecordBatch.from_arrays([words.take(pa.array(rows)), pa.array(grams)], names=["keyword", "gram"])

    return words.select("keyword").mapInArrow(run, "keyword string, gram bigint")


def _wanted(grams: DataFrame) -> BitSet:
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        for batch in batches:
            yield 0, batch.column(0).to_numpy().view(np.uint64)

    return build(grams.select("gram"), hashed, grams.count(), [0], probes=2)[0]


def gram_counts(texts: DataFrame, sizes: list[int], wanted: BitSet) -> DataFrame:
    """(gram, texts): places of the grams that may be wanted."""
    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    def count(batch: pa.RecordBatch, size: int, rows: np.ndarray, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        found, n = np.unique(hashes[shared.value.has(hashes)], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n, pa.int64())], names=["gram", "n"])

    counted = texts.select("text").mapInArrow(lambda batches: _over(batches, "text", sizes, count), "gram bigint, n bigint")
    return counted.groupBy("gram").agg(F.sum("n").alias("texts"))


def text_grams(texts: DataFrame, sizes: list[int], wanted: BitSet) -> DataFrame:
    """(text_id, gram) of the grams that may be wanted."""
    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    def keep(batch: pa.RecordBatch, size: int, rows: np.ndarray, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        ok = shared.value.has(hashes)
        rows, grams = _distinct(rows[ok], hashes[ok])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(grams)], names=["text_id", "gram"])

    return texts.select("text_id", "text").mapInArrow(lambda batches: _over(batches, "text", sizes, keep), "text_id bigint, gram bigint")


def file_keywords(texts: DataFrame, words: DataFrame, sizes: list[int]) -> DataFrame:
    """(gram, keyword): each keyword that may occur, under the gram that makes the fewest candidates."""
    # Shorter grams are fewer, so their bits tell more when texts are many.
    have = text_bits(texts, sorted({*sizes, *(n // 2 for n in sizes if n > 2)}))
    parts = settled(keyword_grams(may_occur(words, have)), "keyword-grams")
    in_texts = gram_counts(texts, sizes, _wanted(parts))
    in_words = parts.groupBy("gram").agg(F.count(F.lit(1)).alias("words"))
    costs = settled(in_words.join(in_texts, "gram").select("gram", (F.col("words") * F.col("texts")).alias("cost")), "gram-costs")
    priced = parts.join(costs, "gram", "left")
    chosen = priced.groupBy("keyword").agg(F.min_by("gram", F.struct("cost", "gram")).alias("gram"), F.count_if(F.col("cost").isNull()).alias("absent"))
    return settled(chosen.where("absent = 0").select("gram", "keyword"), "filed-keywords")


def candidates(texts: DataFrame, filed: DataFrame, sizes: list[int]) -> DataFrame:
    """(text_id, keyword) of keywords whose gram a text has."""
    return text_grams(texts, sizes, _wanted(filed)).join(filed, "gram").select("text_id", "keyword")


def find(texts: DataFrame, words: DataFrame) -> DataFrame:
    """Add ``hits``, the sorted keywords of ``words`` that occur in ``text``. Texts must be distinct; null has no hits.

    Both sides are read more than once, so settle what is costly to make.
    """
    sizes = sorted(r["size"] for r in words.select(_gram_size(F.col("keyword")).alias("size")).distinct().collect())  # at most len(GRAMS)
    known = texts.withColumn("text_id", F.xxhash64("text"))
    none = F.array().cast("array<string>")
    if not sizes:
        return texts.withColumn("hits", none)
    searched = known.select("text_id", "text").where("text IS NOT NULL")
    met = candidates(searched, file_keywords(searched, words, sizes), sizes)
    met = settled(met.groupBy("text_id").agg(F.sort_array(F.collect_set("keyword")).alias("_met")), "candidates")
    verified = F.filter("_met", lambda word: F.contains(F.col("text"), word))
    return known.join(met, "text_id", "left").withColumn("hits", F.coalesce(verified, none)).drop("text_id", "_met")
