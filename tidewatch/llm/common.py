"""What the text operators share: table access, settled tables, and vectorised word hashing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewatch.session import configure, scratch_path

# A batch that reaches Python holds so many rows and about so many bytes; long texts come in smaller batches.
_BATCH_ROWS = "1000"
_BATCH_BYTES = "16777216"
# Texts are looked at in pieces of about this size, so that numpy's temporaries stay small.
CHUNK_BYTES = 2_000_000


def prepared(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", _BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", _BATCH_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def settle(rows: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared folder (compressed) and read back; they survive lost executors."""
    spark = rows.sparkSession
    path = scratch_path(spark, label)
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def encoded(texts: Iterable[str | None]) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]


def chunks(batches: Iterable[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows of ``batches`` with their ``text`` as bytes, in runs of about ``limit`` bytes."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        texts = encoded(batch.column(batch.schema.get_field_index("text")).to_pylist())
        start = size = 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= limit or i == len(texts) - 1:
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, size = i + 1, 0


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, so that every bit depends on all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# A 64-bit value for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0xD6E8FEB86659FD93)
_powers = np.zeros(0, np.uint64)


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, _BASE)]), dtype=np.uint64)
    return _powers


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words ``[^\\x20\\x09-\\x0D]+`` of the texts, A-Z lowered, and where each text's words start.

    The second array has one entry more than there are texts.
    """
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    if not len(texts):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    solid = np.flatnonzero(~_SPACE[data])
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    if not len(solid):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    first = np.flatnonzero(np.diff(solid, prepend=-2) > 1)
    place = np.arange(len(solid)) - np.repeat(first, np.diff(first, append=len(solid)))
    with np.errstate(over="ignore"):
        values = BYTE_VALUES[data[solid]] * _powers_to(int(place.max()) + 1)[place]
        words = mix(np.add.reduceat(values, first))
    return words, np.searchsorted(solid[first], bounds)
