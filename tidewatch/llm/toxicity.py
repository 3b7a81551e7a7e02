"""Toxicity: a linear classifier of character n-grams, scaled by naive Bayes log-count ratios.

A text's features are the hashed byte n-grams (lengths 3 to 5, A-Z lowered, white space as
one blank) that occur in it. A feature's value is its log-count ratio between toxic and
other training texts, if it occurs at all, and a logistic model is fitted on these values.
With ratios r and weights w the model is ``sigmoid(b + sum over features of r * w)``, so
only one table of ``BUCKETS`` products is sent to the tasks; its size does not depend on
the data.

The model is fitted on a bounded sample of the labelled training rows: of each class at
most ``SAMPLE_PER_CLASS`` rows, those with the smallest hash of doc_id. Where a bound
changes the share of toxic rows, the intercept is set back to the share of all usable
labels. Everything else is a pass over all texts, whole.

Defined cases: null and empty texts have no features and get the score of the intercept;
rows without a usable label are not trained on; if no row of one class is there, every
score is the share of the other class; repeated doc_ids are scored row by row, and a label
counts once for each row it joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import BYTE_VALUES, chunks, column, mix

ORDERS = (3, 4, 5)
BUCKETS = 1 << 20
SAMPLE_PER_CLASS = {1: 1000, 0: 3000}
# Features whose ratio is nearly even tell nothing and are left out.
MIN_RATIO = 1.0
# A feature is in so many training texts at least: so many in a hundred of the smaller class, within these bounds.
TEXT_PERCENT = 7
TEXT_BOUNDS = (3, 25)
SMOOTHING = 1.0
# Of the logistic fit.
PENALTY = 1e-3
RATE = 0.05
FOLDS = 5

_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
_FOLDED[[9, 10, 11, 12, 13]] = 32


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts (each once a text), and where each text's begin."""
    parts, starts = [], [0]
    multipliers = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]
    for text in texts:
        data = _FOLDED[np.frombuffer(b" " + text + b" ", np.uint8)] if text.strip() else np.zeros(0, np.uint8)
        keep = np.ones(len(data), bool)
        keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
        values = BYTE_VALUES[data[keep]]
        found = []
        grown = values
        with np.errstate(over="ignore"):
            for order in range(2, max(ORDERS) + 1):
                if len(values) < order:
                    break
                grown = grown[:-1] * multipliers[order & 1] + values[order - 1 :]
                if order in ORDERS:
                    found.append((mix(grown) >> np.uint64(44)).astype(np.int64))
        ids = np.concatenate(found) if found else np.zeros(0, np.int64)
        parts.append(_once(ids))
        starts.append(starts[-1] + len(parts[-1]))
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), np.array(starts)


_place = np.zeros(BUCKETS, np.int32)


def _once(ids: np.ndarray) -> np.ndarray:
    """Each number once: of equal ones only the last place written counts."""
    at = np.arange(len(ids), dtype=np.int32)
    _place[ids] = at
    return ids[_place[ids] == at]


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


def least_texts(toxic: int, other: int) -> int:
    """So many training texts a feature is in at least; never more than the smaller class has."""
    smaller, (least, most) = min(toxic, other), TEXT_BOUNDS
    return min(smaller, most, max(least, -(-TEXT_PERCENT * smaller // 100)))


@dataclass
class Model:
    weights: np.ndarray  # ratio times weight, for each bucket
    intercept: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        ids, starts = features(texts)
        sums = np.concatenate([[0.0], np.cumsum(self.weights[ids], dtype=np.float64)])
        return 1 / (1 + np.exp(-np.clip(sums[starts[1:]] - sums[starts[:-1]] + self.intercept, -40, 40)))


def usable_labels(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(
        F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold(F.col("doc_id")) != 0)
    )


def sample_rows(docs: DataFrame, labels: DataFrame, per_class: dict[int, int] = SAMPLE_PER_CLASS) -> DataFrame:
    """toxic, text of the bounded training sample."""
    usable = usable_labels(labels)
    picked = None
    for toxic, most in per_class.items():
        part = usable.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    # At most sum(per_class) ids, so they are broadcast.
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", "text")


def prior_shift(labels: DataFrame, per_class: dict[int, int] = SAMPLE_PER_CLASS) -> float:
    """What the sample's bounds took from the log-odds of toxic: 0 if no class reaches its bound."""
    rows = {r["toxic"]: r["count"] for r in usable_labels(labels).groupBy("toxic").count().collect()}
    toxic, other = (log(rows[t] / min(rows[t], per_class[t])) if t in rows else 0.0 for t in (1, 0))
    return toxic - other


def fit(docs: DataFrame, labels: DataFrame, per_class: dict[int, int] = SAMPLE_PER_CLASS, steps: int = 200) -> Model:
    """Fit on the bounded sample; features are extracted by the tasks, and the logistic model is fitted on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            ids, starts = features(texts)
            blobs = [ids[a:b].astype(np.uint32).tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "toxic"), pa.array(blobs, pa.binary())], names=["doc_id", "toxic", "ids"]
            )

    rows = sample_rows(docs, labels, per_class).mapInArrow(run, "doc_id bigint, toxic int, ids binary")
    # Equal feature sets with one label (copies) count once; rows are put in a fixed order.
    kept = sorted({(bytes(r["ids"]), r["toxic"]) for r in rows.toLocalIterator()})
    seen = np.zeros((2, BUCKETS), np.float32)
    for blob, toxic in kept:
        seen[toxic][np.frombuffer(blob, np.uint32)] += 1
    y = np.array([t for _, t in kept], np.float64)
    if not len(y) or y.min() == y.max():
        share = float(y[0]) if len(y) else 0.0
        return Model(np.zeros(BUCKETS, np.float32), 4.0 if share else -4.0)
    p, q = SMOOTHING + seen[1], SMOOTHING + seen[0]
    ratio = np.log(p / (y.sum() + 2 * SMOOTHING)) - np.log(q / ((1 - y).sum() + 2 * SMOOTHING))
    used = np.flatnonzero((np.abs(ratio) >= MIN_RATIO) & (seen.sum(0) >= least_texts(int(y.sum()), int((1 - y).sum()))))
    number = np.full(BUCKETS, -1, np.int32)
    number[used] = np.arange(len(used))
    columns, sizes = [], []
    for blob, _ in kept:
        c = number[np.frombuffer(blob, np.uint32)]
        columns.append(c[c >= 0])
        sizes.append(len(columns[-1]))
    model = _logistic(np.concatenate(columns), np.repeat(np.arange(len(y)), sizes), ratio[used], used, y, steps)
    return Model(model.weights, model.intercept + prior_shift(labels, per_class))


def _logistic(cols: np.ndarray, rows: np.ndarray, ratio: np.ndarray, used: np.ndarray, y: np.ndarray, steps: int) -> Model:
    """Logistic regression with an L2 penalty, by Adam over the whole sample."""
    n = len(y)
    value = ratio[cols].astype(np.float64)
    w, b = np.zeros(len(used)), float(np.log(y.mean() / (1 - y.mean())))
    mean, square = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, steps + 1):
        z = np.bincount(rows, value * w[cols], n) + b
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n
        slope = np.append(np.bincount(cols, value * error[rows], len(w)) + PENALTY * w, error.sum())
        mean = 0.9 * mean + 0.1 * slope
        square = 0.999 * square + 0.001 * slope**2
        move = RATE * (1 - t / (steps + 1)) * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-12)
        w, b = w - move[:-1], b - float(move[-1])
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = w * ratio
    return Model(weights, float(b))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(shared.value.scores(texts))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents whose score is below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            yield batch.filter(pa.array(shared.value.scores(texts) < threshold))

    return docs.mapInArrow(run, docs.schema)
