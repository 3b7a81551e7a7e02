"""Quality: a linear-chain conditional random field labels each line of a text good or bad.

A line is described by measures of its bytes and words (shares of letters, capitals, signs, repeated words and lines, and so on),
of the line before, and of the line after. The field has a weight for each of these and one for each pair of
neighbouring labels; forward-backward gives the probability that a line is good, given the whole text. A document's
score is the mean of its lines' probabilities, each line weighted by its length in bytes.

The field is fitted on documents' labels: every line of a training text takes the label of its document. The sample is bounded:
at most ``SAMPLE_DOCUMENTS`` labelled documents, those with the smallest hash of doc_id, without documents of more than
``SAMPLE_LINES`` lines. All else is a pass over all texts, whole. Texts are walked in step with each other, line by
line, so a text of very many lines costs time, but no more memory than its measures.

Defined cases: null and empty texts get the share of good documents in the sample, which is also every score if only one
label is there (0.5 if none is); rows without a usable label are not trained on; repeated doc_ids are scored row by row, and a
label counts once for each row it joins; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import _SPACE, BYTE_VALUES, _powers_to, chunks, column, mix

SAMPLE_DOCUMENTS = 4000
SAMPLE_LINES = 2000
FOLDS = 3
HELD_OUT = 1
# Of the fit.
PENALTY = 2e-3
RATE = 0.1
STEPS = 150

# Kinds of bytes.
_LOWER, _UPPER, _DIGIT, _BLANK, _SIGN, _CALL, _STOP, _OTHER, _HIGH = range(9)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[97:123] = _LOWER
_KIND[65:91] = _UPPER
_KIND[48:58] = _DIGIT
_KIND[[32, *range(9, 14)]] = _BLANK
_KIND[[*b"#*$%&|<>=~^@_+\\/{}[]"]] = _SIGN
_KIND[[*b"!?"]] = _CALL
_KIND[[*b".,;:"]] = _STOP
_KIND[128:] = _HIGH

MEASURES = [
    "length", "words", "word_length", "capitals", "digits", "signs", "calls", "stops", "others", "high", "same_as_before", "repeated_in_line",
    "repeated_grams", "ends_in_sign", "lone_signs", "short_words", "repeated_line", "begins_capital", "ends_in_stop", "empty",
]
_GRAM = 3


def _word_table(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, length and hash of each word."""
    solid = np.flatnonzero(~_SPACE[data])
    if not len(solid):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    heads = np.flatnonzero(np.diff(solid, prepend=-2) > 1)
    sizes = np.diff(heads, append=len(solid))
    place = np.arange(len(solid)) - np.repeat(heads, sizes)
    with np.errstate(over="ignore"):
        values = BYTE_VALUES[data[solid]] * _powers_to(int(place.max()) + 1)[place]
        return solid[heads], sizes, mix(np.add.reduceat(values, heads))


def _again(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    _, place, times = np.unique(keys, return_inverse=True, return_counts=True)
    return times[place] > 1


def measures(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Measures of all lines (a row each), their lengths in bytes, and where each text's lines begin (one more)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.append(0, ends[:-1] + 1)
    size = ends - starts
    bounds = np.append(0, np.searchsorted(ends, np.cumsum([len(t) + 1 for t in texts]) - 1) + 1)
    n = len(ends)
    line = np.repeat(np.arange(n, dtype=np.int64), size + 1)
    kinds = np.bincount(line * 16 + _KIND[data], minlength=16 * n).reshape(n, 16).astype(np.float64)
    kinds[:, _BLANK] -= 1  # the line feed
    first, length, word = _word_table(data)
    of = line[first]
    text_of = np.repeat(np.arange(len(texts)), np.diff(bounds))
    doc = text_of[of]
    words = np.bincount(of, minlength=n).astype(np.float64)
    last_kind, first_kind = _KIND[data[first + length - 1]], _KIND[data[first]]

    def share(flags: np.ndarray) -> np.ndarray:
        return np.bincount(of, flags, n) / np.maximum(words, 1)

    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    grams = np.zeros(len(word), bool)
    if len(word) >= _GRAM:
        with np.errstate(over="ignore"):
            keys = word[:-2] * np.uint64(0x9E3779B97F4A7C15) + mix(word[1:-1] + np.uint64(1)) * np.uint64(3) + word[2:] + mix(doc[:-2].astype(np.uint64))
        within = doc[:-2] == doc[2:]
        hit = np.flatnonzero(_again(keys) & within)
        for i in range(_GRAM):
            grams[hit + i] = True
    with np.errstate(over="ignore"):
        in_line = _again(word + mix(of.astype(np.uint64) + np.uint64(7)))
        # A line by its words: sums of their hashes, each mixed with its place.
        place = np.arange(len(word)) - np.repeat(np.append(0, np.cumsum(np.bincount(of, minlength=n)))[:-1], np.bincount(of, minlength=n))
        sums = np.zeros(n, np.uint64)
        np.add.at(sums, of, mix(word + place.astype(np.uint64)))
        repeated = _again(mix(sums) + mix(text_of.astype(np.uint64))) & (words > 0)
    bytes_ = np.maximum(size, 1)
    letters = np.maximum(kinds[:, _LOWER] + kinds[:, _UPPER], 1)
    begins, closes = np.zeros(n), np.zeros(n)
    heads = np.flatnonzero(np.diff(of, prepend=-1))
    begins[of[heads]] = (first_kind[heads] == _UPPER) | (first_kind[heads] == _HIGH)
    tails = np.append(heads[1:], len(of)) - 1
    closes[of[heads]] = (last_kind[tails] == _STOP) if len(heads) else 0
    lone = (length <= 2) & ((first_kind == _SIGN) | (first_kind == _CALL) | (first_kind == _OTHER))
    columns = [
        np.log1p(size) / 8, np.log1p(words) / 6, np.bincount(of, length, n) / np.maximum(words, 1) / 10, kinds[:, _UPPER] / letters,
        *(kinds[:, k] / bytes_ for k in (_DIGIT, _SIGN, _CALL, _STOP, _OTHER, _HIGH)), share(same), share(in_line), share(grams),
        share((last_kind == _SIGN) | (last_kind == _CALL)), share(lone), share(length <= 3), repeated, begins, closes, words == 0,
    ]
    return np.stack([np.asarray(c, np.float32) for c in columns], axis=1), size, bounds


def with_neighbours(rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Each line's measures beside those of the line before and the line after (zeros at the edges), and marks of the edges."""
    edge = np.zeros((len(rows), 2), np.float32)
    before, after = np.zeros_like(rows), np.zeros_like(rows)
    before[1:], after[:-1] = rows[:-1], rows[1:]
    first, last = bounds[:-1], bounds[1:] - 1
    before[first], after[last] = 0, 0
    edge[first, 0], edge[last, 1] = 1, 1
    return np.hstack([rows, before, after, edge])


def _in_step(bounds: np.ndarray) -> Iterator[np.ndarray]:
    """The texts' first lines, then the second lines of those that have one, and so on; texts by falling number of lines."""
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    first, falling = bounds[:-1][order], -size[order]
    for t in range(int(size.max()) if len(size) else 0):
        yield first[: np.searchsorted(falling, -t, side="left")] + t


def forward_backward(good: np.ndarray, pairs: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Probability that each line is good, expected pairs of labels (summed), and the sum of log partition functions.

    ``good`` is each line's weight for the label good (that for bad is 0), ``pairs[i, j]`` the weight of label j after i.
    """
    emit = np.stack([np.zeros(len(good)), good], axis=1)
    forward, backward = np.zeros((len(good), 2)), np.zeros((len(good), 2))
    steps = list(_in_step(bounds))
    for t, at in enumerate(steps):
        forward[at] = emit[at]
        if t:
            came = forward[at - 1]
            forward[at] += np.logaddexp(came[:, :1] + pairs[0], came[:, 1:] + pairs[1])
    for at in reversed(steps[1:]):
        ahead = emit[at] + backward[at]
        backward[at - 1] = np.logaddexp(ahead[:, :1] + pairs[:, 0], ahead[:, 1:] + pairs[:, 1])
    total = np.logaddexp(forward[:, 0] + backward[:, 0], forward[:, 1] + backward[:, 1])
    probability = np.exp(np.minimum(forward[:, 1] + backward[:, 1] - total, 0))
    expected = np.zeros((2, 2))
    inner = np.ones(len(good), bool)
    inner[bounds[:-1]] = False
    at = np.flatnonzero(inner)
    for i in (0, 1):
        for j in (0, 1):
            expected[i, j] = np.exp(forward[at - 1, i] + pairs[i, j] + emit[at, j] + backward[at, j] - total[at]).sum()
    return probability, expected, float(total[bounds[1:] - 1].sum())


@dataclass
class Model:
    weights: np.ndarray  # of scaled measures, the last of the constant
    pairs: np.ndarray
    middle: np.ndarray
    spread: np.ndarray
    share: float  # of good documents
    fitted: bool = True

    def line_probabilities(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability that each line is good, its length, and where each text's lines begin."""
        rows, size, bounds = measures(texts)
        if not self.fitted:
            return np.full(len(rows), self.share), size, bounds
        scaled = (with_neighbours(rows, bounds) - self.middle) / self.spread
        good = scaled @ self.weights[:-1] + self.weights[-1]
        return forward_backward(good.astype(np.float64), self.pairs, bounds)[0], size, bounds

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        probability, size, bounds = self.line_probabilities(texts)
        heavy = np.add.reduceat(size * probability, bounds[:-1])
        weight = np.add.reduceat(size.astype(np.float64), bounds[:-1])
        return np.where(weight > 0, np.clip(heavy / np.maximum(weight, 1), 0, 1), self.share)


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


def sample_rows(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """doc_id, good, text of the bounded training sample."""
    usable = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("good")).where(
        F.col("doc_id").isNotNull() & F.col("good").isin(0, 1) & (fold(F.col("doc_id")) != HELD_OUT)
    )
    # At most ``most`` rows, so they are broadcast.
    picked = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "good").limit(most)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(picked), "doc_id").select("doc_id", "good", "text")


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCUMENTS, most_lines: int = SAMPLE_LINES) -> Model:
    """Fit on the bounded sample; the tasks measure the lines, the field is fitted on the measures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            short = [t if t.count(b"\n") < most_lines else b"" for t in texts]
            rows, _, bounds = measures(short)
            blobs = [rows[a:b].tobytes() if t else b"" for t, a, b in zip(short, bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([column(batch, "good"), pa.array(blobs, pa.binary())], names=["good", "rows"])

    # Copies with one label count once; rows are put in a fixed order.
    rows = sample_rows(docs, labels, most).mapInArrow(run, "good int, rows binary")
    kept = sorted({(bytes(r["rows"]), r["good"]) for r in rows.toLocalIterator() if r["rows"]})
    y = np.array([g for _, g in kept], np.float64)
    share = float(y.mean()) if len(y) else 0.5
    wide = 3 * len(MEASURES) + 2
    if share in (0.0, 1.0) or not len(y):
        return Model(np.zeros(wide + 1), np.zeros((2, 2)), np.zeros(wide), np.ones(wide), share, fitted=False)
    parts = [np.frombuffer(b, np.float32).reshape(-1, len(MEASURES)) for b, _ in kept]
    bounds = np.cumsum([0] + [len(p) for p in parts])
    inputs = with_neighbours(np.concatenate(parts), bounds)
    middle, spread = inputs.mean(0), inputs.std(0)
    spread[spread < 1e-4] = 1
    weights, pairs = _maximise((inputs - middle) / spread, np.repeat(y, np.diff(bounds)), bounds)
    return Model(weights, pairs, middle, spread, share)


def _maximise(inputs: np.ndarray, labels: np.ndarray, bounds: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the largest penalised likelihood, by Adam over the whole sample."""
    n = len(bounds) - 1
    at = np.zeros(inputs.shape[1] + 5)
    mean, square = np.zeros_like(at), np.zeros_like(at)
    given = np.zeros((2, 2))
    inner = np.ones(len(labels), bool)
    inner[bounds[:-1]] = False
    for i, j in zip(labels[np.flatnonzero(inner) - 1].astype(int), labels[inner].astype(int), strict=True):
        given[i, j] += 1
    for t in range(1, steps + 1):
        good = inputs @ at[:-5].astype(np.float32) + at[-5]
        probability, expected, _ = forward_backward(good.astype(np.float64), at[-4:].reshape(2, 2), bounds)
        error = (probability - labels).astype(np.float32)
        slope = np.concatenate([error @ inputs, [error.sum()], (expected - given).ravel()]) / n + PENALTY * at
        mean = 0.9 * mean + 0.1 * slope
        square = 0.999 * square + 0.001 * slope**2
        at = at - RATE * (1 - t / (steps + 1)) * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-12)
    return at[:-4], at[-4:].reshape(2, 2)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(shared.value.scores(texts))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, score double")


def label_lines(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, line (from 0), length in bytes, probability, good of every line of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            probability, size, bounds = shared.value.line_probabilities(texts)
            of = np.repeat(np.arange(len(texts)), np.diff(bounds))
            for a in range(0, len(of), 100_000):
                part = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [
                        column(batch, "doc_id").take(pa.array(of[part])),
                        pa.array((np.arange(len(of)) - bounds[of])[part]),
                        pa.array(size[part]),
                        pa.array(probability[part]),
                        pa.array(probability[part] >= 0.5),
                    ],
                    names=["doc_id", "line", "length", "probability", "good"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, line bigint, length bigint, probability double, good boolean")
