"""Bloom filters of bounded size: built by a distributed aggregate, tested inside a scan, batch or stream.

A filter is a table of one row: an array of 64-bit words, at most ``MOST_BITS`` bits, whatever the
number of values. A test reads it as a scalar subquery, so rows that cannot match go before anything is shuffled.
It may let others through, never the wrong way round.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import settled

BITS_PER_VALUE = 12
LEAST_BITS = 1 << 12
MOST_BITS = 1 << 24
PROBES = 4
# With fewer bits for a value a filter lets more than a sixth of other values through.
LEAST_BITS_PER_VALUE = 4


def _positions(value: Column, bits: int) -> list[Column]:
    """Bits of a value."""
    return [F.xxhash64(value, F.lit(probe)).bitwiseAND(F.lit(bits - 1)) for probe in range(PROBES)]


@dataclass
class BloomFilter:
    words: DataFrame  # one row, one column: array<bigint>
    bits: int

    def may_contain(self, value: Column) -> Column:
        """False only for values that were not added; null is never contained."""
        words = self.words.scalar()
        set_ = F.lit(True)
        for at in _positions(value, self.bits):
            word = F.get(words, F.shiftright(at, 6).cast("int"))
            set_ = set_ & (F.getbit(word, at.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return F.coalesce(value.isNotNull() & set_, F.lit(False))


def build(values: DataFrame, column: str, label: str, most_bits: int = MOST_BITS) -> BloomFilter:
    """A filter of the column's values, sized by their number up to ``most_bits`` (a power of two)."""
    return _build(values, column, label, most_bits, values.count())


def build_if_useful(values: DataFrame, column: str, label: str, most_bits: int = MOST_BITS) -> BloomFilter | None:
    """The same, or None if the values are too many for ``most_bits``."""
    count = values.count()
    return _build(values, column, label, most_bits, count) if LEAST_BITS_PER_VALUE * count <= most_bits else None


def _build(values: DataFrame, column: str, label: str, most_bits: int, count: int) -> BloomFilter:
    bits = LEAST_BITS
    while bits < min(most_bits, BITS_PER_VALUE * count):
        bits *= 2
    ones = values.select(F.explode(F.array(*_positions(F.col(column), bits))).alias("at")).where("at IS NOT NULL")
    marked = ones.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, CAST(at & 63 AS INT))").alias("bit"))
    empty = values.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bit"))
    words = marked.unionByName(empty).groupBy("word").agg(F.bit_or("bit").alias("bit"))
    # At most most_bits / 64 rows.
    row = words.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bit"))), lambda w: w["bit"]).alias("words"))
    return BloomFilter(settled(row, label), bits)
