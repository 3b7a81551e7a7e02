"""Benchmark decontamination: one Aho-Corasick automaton, one scan of each text.

A word is a run of ASCII digits, letters or any non-ASCII characters, with A-Z lowered. The
patterns are the windows of ``width`` consecutive words of each benchmark item (an item
with fewer words is one window). They are put between spaces and searched in the
normalised text; hits are traced back to words, and those to byte offsets of the original.

The automaton grows with the benchmark, not with the documents, and never beyond
``PATTERN_BYTES``: a larger benchmark is split into blocks of items, each with its own
automaton and pass, which adds its hits to those of the passes before.

Defined cases: null or empty texts have no words and are clean; items without words or
id match nothing; repeated items and documents each count by themselves (equal item ids
as one item); other columns are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from tidewatch.llm.common import column, encoded

WIDTH = 13
PATTERN_BYTES = 8_000_000
# A document is contaminated if it has a hit word and at least this share of its words is hit.
MIN_SHARE = 20

_NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def patterns(items: list[tuple[str, str | None]], width: int = WIDTH) -> dict[str, tuple[int, tuple[str, ...]]]:
    """Window -> its number of words and the items that have it."""
    found: dict[str, tuple[int, set[str]]] = {}
    for item, text in items:
        words = words_of(encoded([text])[0])
        for start in range(max(1, len(words) - width + 1) if words else 0):
            part = words[start : start + width]
            key = " " + b" ".join(part).decode("latin-1") + " "
            found.setdefault(key, (len(part), set()))[1].add(item)
    return {k: (n, tuple(sorted(ids))) for k, (n, ids) in found.items()}


def automaton(items: list[tuple[str, str | None]], width: int = WIDTH):
    made = ahocorasick.Automaton()
    for key, value in patterns(items, width).items():
        made.add_word(key, value)
    made.make_automaton()
    return made


def hits(text: bytes, made) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, runs of hit words [from, to), items found."""
    words = words_of(text)
    if not words or not len(made):
        return len(words), [], set()
    line = " " + b" ".join(words).decode("latin-1") + " "
    found = list(made.iter(line))
    if not found:
        return len(words), [], set()
    gaps = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
    ends = np.searchsorted(gaps, [end for end, _ in found])
    runs = [(int(e) - n, int(e)) for e, (_, (n, _)) in zip(ends, found, strict=True)]
    return len(words), merged(runs), {i for _, (_, ids) in found for i in ids}


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs that touch or overlap become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def byte_spans(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same runs as byte offsets [from, to) of the original text."""
    if not runs:
        return []
    spans = [m.span() for m in _WORD.finditer(text)]
    return [(spans[a][0], spans[b - 1][1]) for a, b in runs]


def contaminated(n_words: int, runs: list[tuple[int, int]]) -> bool:
    n_hit = sum(b - a for a, b in runs)
    return n_hit > 0 and MIN_SHARE * n_hit >= n_words


_built: tuple | None = None


def _automaton_of(shared, width: int):
    """The automaton of a broadcast list of items; a Python worker keeps the last one."""
    global _built
    if _built is None or _built[:2] != (width, shared.value):
        _built = width, shared.value, automaton(shared.value, width)
    return _built[2]


def _item_blocks(benchmark: DataFrame, width: int) -> list[list[tuple[str, str | None]]]:
    """Items in blocks whose patterns stay below PATTERN_BYTES."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where(
        "item_id IS NOT NULL AND text IS NOT NULL"
    )
    size = items.agg(F.sum(F.octet_length("text") * F.lit(width))).first()[0] or 0
    n = 1 + int(size) // PATTERN_BYTES
    spread = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    return [[(r[0], r[1]) for r in spread.where(F.col("block") == b).select("item_id", "text").collect()] for b in range(n)]


_SPANS = "array<struct<first:bigint,last:bigint>>"
_FOUND = f"struct<n_words:bigint,runs:{_SPANS},spans:{_SPANS},items:array<string>,contaminated:boolean>"


def with_hits(docs: DataFrame, benchmark: DataFrame, name: str, width: int = WIDTH) -> DataFrame:
    """The documents with one more column: a struct of the number of words, the hit runs in words and in
    bytes of the original, the items found, and the verdict."""
    spark = docs.sparkSession
    schema = StructType([*docs.schema, StructField(name, StructType.fromDDL(f"found {_FOUND}")[0].dataType)])
    kind = to_arrow_type(schema[-1].dataType)

    def one_pass(rows: DataFrame, items, first: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = _automaton_of(shared, width)
            for batch in batches:
                before = [None] * batch.num_rows if first else column(batch, name).to_pylist()
                found = []
                for text, old in zip(encoded(column(batch, "text").to_pylist()), before, strict=True):
                    n, runs, ids = hits(text, made)
                    if old:
                        runs = merged(runs + [(r["first"], r["last"]) for r in old["runs"]])
                        ids |= set(old["items"])
                    as_rows = lambda xs: [{"first": a, "last": b} for a, b in xs]
                    found.append(
                        {
                            "n_words": n,
                            "runs": as_rows(runs),
                            "spans": as_rows(byte_spans(text, runs)),
                            "items": sorted(ids),
                            "contaminated": contaminated(n, runs),
                        }
                    )
                columns = batch.columns if first else batch.columns[:-1]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, kind)], names=schema.names)

        return rows.mapInArrow(run, schema)

    rows = docs
    for i, items in enumerate(_item_blocks(benchmark, width)):
        rows = one_pass(rows, items, i == 0)
    return rows


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per document: n_words, runs, spans, items, contaminated."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_hits(rows, benchmark, "found", width).select("doc_id", "found.*")


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    name = "found"
    while name in docs.columns:
        name += "_"
    return with_hits(docs, benchmark, name, width).where(~F.col(f"{name}.contaminated")).drop(name)
