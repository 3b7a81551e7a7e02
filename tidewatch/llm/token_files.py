"""Token ids of all documents as one long array, cut into files, with Elias-Fano document boundaries.

Documents are range-partitioned and sorted by ``doc_id`` (nulls first, equal ids by text),
tokenised, and written to files of about ``FILE_IDS`` ids each. A file has the ids of its
documents end to end (16 bits each if the vocabulary allows, else 32), their ids'
boundaries as an Elias-Fano sequence, and the ``doc_id`` values. Offsets of documents come
from that sequence's select structure; no table of 64-bit offsets exists.

The list of files (the manifest) is what the successful tasks report, so files of tasks
that failed or ran twice are never read. Where a file's ids begin in the whole array
follows from the sizes in the manifest, which has a row for each file only.

Texts are cut where the tokenizer's pattern always starts a new piece. Arrow finds the different parts of
a run of texts, the tokenizer sees those that a cache of bounded size does not have, and Arrow puts
their ids in the order of the texts.

Defined cases: null is the empty text (only the end id); repeated rows are written as
often as they occur; an empty table gives no file; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import chunks, column, settle
from tidewatch.llm.elias_fano import EliasFano, map_arrays, write_arrays
from tidewatch.llm.parts import ByteLevel, Known, cut

FILE_IDS = 4_000_000
_CHUNK = 8_000_000


class Encoder:
    """A tokenizer file opened once, with a cache of what parts of texts become."""

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer = ByteLevel(tokenizer)
        self.dtype = np.dtype("<u2") if tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.known = Known(self._learn)

    def _learn(self, parts: list[bytes]) -> list[bytes]:
        ids, ends = self.tokenizer.encode(parts)
        blob, size = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
        cuts = [0, *(ends * size).tolist()]
        return [blob[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian integers of ``dtype``."""
        found = cut(texts, stops=True)
        if not len(found.index):
            return [b""] * len(texts)
        ids = pa.array(self.known.of(found.parts), pa.large_binary()).take(pa.array(found.index))
        ends, data = np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1], memoryview(ids.buffers()[2] or b"")
        bounds = ends[found.starts].tolist()
        return [bytes(data[a:b]) for a, b in zip(bounds, bounds[1:])]


_encoders: dict[str, Encoder] = {}


def encoder(tokenizer_file: str) -> Encoder:
    if tokenizer_file not in _encoders:
        _encoders[tokenizer_file] = Encoder(tokenizer_file)
    return _encoders[tokenizer_file]


def _write(folder: str, ids: list[bytes], doc_ids: list[int | None], dtype: np.dtype) -> tuple[str, int, int]:
    lengths = np.array([len(x) // dtype.itemsize for x in ids], np.int64)
    path = write_arrays(
        folder,
        {
            "ids": np.frombuffer(b"".join(ids), dtype),
            "doc_ids": np.array([d or 0 for d in doc_ids], np.int64),
            "null_ids": np.array([d is None for d in doc_ids], np.uint8),
            **EliasFano.build(np.cumsum(lengths)).parts("ends"),
        },
    )
    return path, len(doc_ids), int(lengths.sum())


def write_token_files(docs: DataFrame, tokenizer_file: str, folder: str, end_id: int, partitions: int | None = None) -> DataFrame:
    """Tokenise and write; returns the manifest: part, file, path, n_docs, n_ids, in global order of (part, file)."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange(n, "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .withColumn("part", F.spark_partition_id())
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = encoder(tokenizer_file)
        end = np.array([end_id], use.dtype).tobytes()
        ids: list[bytes] = []
        owners: list[int | None] = []
        held = file = 0
        part = 0

        def out() -> pa.RecordBatch:
            path, n_docs, n_ids = _write(folder, ids, owners, use.dtype)
            return pa.RecordBatch.from_pydict(
                {"part": [part], "file": [file], "path": [path], "n_docs": [n_docs], "n_ids": [n_ids]}, schema=_MANIFEST
            )

        for batch, texts in chunks(batches, _CHUNK):
            part = column(batch, "part")[0].as_py()
            for doc, got in zip(column(batch, "doc_id").to_pylist(), use.encode(texts), strict=True):
                ids.append(got + end)
                owners.append(doc)
                held += len(got) + len(end)
                if held >= FILE_IDS * use.dtype.itemsize:
                    yield out()
                    ids, owners, held, file = [], [], 0, file + 1
        if owners:
            yield out()

    return settle(rows.mapInArrow(run, "part int, file int, path string, n_docs bigint, n_ids bigint"), "token-manifest")


_MANIFEST = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document, from the files."""
    files = manifest.orderBy("part", "file").select("path", "n_ids").collect()
    starts = np.concatenate([[0], np.cumsum([r["n_ids"] for r in files], dtype=np.int64)]) if files else [0]
    rows = [(r["path"], int(s)) for r, s in zip(files, starts)]
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    if not rows:
        return spark.createDataFrame([], schema)
    parts = min(len(rows), max(spark.sparkContext.defaultParallelism, len(rows) // 4))
    listed = spark.createDataFrame(rows, "path string, start bigint").repartition(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(column(batch, "path").to_pylist(), column(batch, "start").to_pylist(), strict=True):
                arrays = map_arrays(path)
                ids, ends = arrays["ids"], EliasFano.open(arrays, "ends")
                stop = ends.access(np.arange(ends.n)).astype(np.int64)
                first = np.concatenate([[0], stop[:-1]])
                crcs = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(first.tolist(), stop.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.asarray(arrays["doc_ids"]), mask=np.asarray(arrays["null_ids"]).astype(bool)),
                        pa.array(first + start),
                        pa.array(stop - first),
                        pa.array(crcs, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return listed.mapInArrow(run, schema)


def document_ids(path: str, index: int) -> np.ndarray:
    """The ids of the document at position ``index`` of a file, by the boundaries' select structure."""
    arrays = map_arrays(path)
    ends = EliasFano.open(arrays, "ends")
    if index >= ends.n or index < 0:
        raise IndexError(index)
    stop = int(ends.access(np.array([index]))[0])
    start = int(ends.access(np.array([index - 1]))[0]) if index else 0
    return np.asarray(arrays["ids"][start:stop])
