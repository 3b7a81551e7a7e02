"""A bigram language model in Elias-Fano trie files, and scoring of whole texts with it.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered (64-bit hashes), and one end token a
text, which is also the context of the first word.

Training counts all words, then all pairs, in shards: each task adds up what it has read
and sends sorted, packed arrays; a shard (a range of word hashes, so a range of contexts)
adds up its part and writes it as a file. Shards grow in number with the corpus, not in size.

A shard's trie has two levels. The first lists the words (sorted hashes; a word's number
is its rank) with their counts and their contexts' back-off weights. The second has each
context's successors: Elias-Fano *pointers* to where they begin, and their numbers, which
are made to rise across contexts (each context's start where the one before ended) and
stored as one Elias-Fano sequence. A pair is looked up relative to its context: pointers
give the range and the base, then the first value not below base + word is searched for.
Probabilities are smoothed with the word frequencies (a Dirichlet prior whose strength is
chosen by leave-one-out likelihood over all pairs), and stored in 8 bits each. Readers map
the files into memory, so tasks on one machine share the pages that they touch.

The unigram base, ``log10((c + 0.5) / (N + 0.5 (V + 1)))``, is exact.

Defined cases: null and empty texts have the end token only; a null doc_id is held out;
repeated rows count as often as they occur; an empty training table gives a model that
knows no word (N = V = 0); further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import chunks, column, hashed_words, mix, settle
from tidewatch.llm.elias_fano import EliasFano, map_arrays, write_arrays

SHARD_TOKENS = 6_000_000
_CHUNK = 4_000_000
# What a task holds before it sends it on.
_HELD = 1_500_000
END = int(mix(np.array([0xE0D], np.uint64))[0])
_HALF = np.uint64(32)

# log10 probabilities from 0 down to LOWEST in equal steps of one byte.
LOWEST = 12.0
_STEP = LOWEST / 255
# Strengths of the prior that are tried.
STRENGTHS = (0.5, 2.0, 8.0, 32.0, 128.0, 512.0, 2048.0, 8192.0, 65536.0, 1048576.0)


def quantised(log10_p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10_p / _STEP), 0, 255).astype(np.uint8)


def restored(code: np.ndarray) -> np.ndarray:
    return code.astype(np.float64) * -_STEP


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(True))


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, the end token last in each, and where each text begins (one more)."""
    words, starts = hashed_words(texts)
    out = np.insert(words, starts[1:], np.uint64(END))
    return out, starts + np.arange(len(starts))


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    heads = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return k[heads], np.add.reduceat(c, heads) if len(k) else c


class _Tally:
    """Counts of keys that a task has seen; ``rows`` packs them by shard."""

    def __init__(self, shard_of):
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held, self.shard_of = 0, shard_of

    def add(self, keys: np.ndarray) -> None:
        k, c = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.counts.append(c.astype(np.int64))
        self.held += len(k)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.keys:
            return
        k, c = _summed(self.keys, self.counts)
        self.keys, self.counts, self.held = [], [], 0
        shard = self.shard_of(k)
        heads = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
        ends = np.append(heads[1:], len(k))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(shard[heads], pa.int32()),
                pa.array([k[a:b].tobytes() for a, b in zip(heads, ends, strict=True)], pa.binary()),
                pa.array([c[a:b].astype(np.uint32).tobytes() for a, b in zip(heads, ends, strict=True)], pa.binary()),
            ],
            names=["shard", "keys", "counts"],
        )


_PACKED = "shard int, keys binary, counts binary"


def _unpacked(rows: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    blobs = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in rows.column(name)]
    keys, counts = _summed(blobs("keys", np.uint64), [c.astype(np.int64) for c in blobs("counts", np.uint32)])
    return rows.column("shard")[0].as_py(), keys, counts


@dataclass
class Model:
    """Where the shards' files are, and the totals; a few values for each shard."""

    shards: int
    words: list[str | None]  # paths by shard: hashes and counts
    first: np.ndarray  # number of the first word of each shard, and of the end
    tokens: int  # N
    pairs: list[tuple[str, str] | None] | None = None  # paths by shard: trie, probabilities
    strength: float = 1.0

    @property
    def size(self) -> int:
        """V"""
        return int(self.first[-1])

    def word_shard(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> _HALF) * np.uint64(self.shards) >> _HALF).astype(np.int64)

    def log10_unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.size + 1)))

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (-1: unknown) and counts of words given by rising hashes."""
        number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        cuts = np.searchsorted(self.word_shard(hashes), np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            if self.words[s] is None:
                continue
            part = slice(cuts[s], cuts[s + 1])
            level = _mapped(self.words[s])
            at = np.searchsorted(level["hashes"], hashes[part])
            at_in = np.minimum(at, len(level["hashes"]) - 1)
            known = level["hashes"][at_in] == hashes[part]
            number[part] = np.where(known, at + self.first[s], -1)
            count[part] = np.where(known, level["counts"][at_in], 0)
        return number, count

    def counts_of(self, numbers: np.ndarray) -> np.ndarray:
        """Counts of words given by their numbers."""
        out = np.zeros(len(numbers), np.int64)
        shard = np.searchsorted(self.first, numbers, side="right") - 1
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            part = order[cuts[s] : cuts[s + 1]]
            out[part] = _mapped(self.words[s])["counts"][numbers[part] - self.first[s]]
        return out

    def log10_pairs(self, contexts: np.ndarray, words: np.ndarray, log10_word: np.ndarray) -> np.ndarray:
        """log10 probabilities of words after known contexts (pairs in rising order)."""
        out = np.zeros(len(words))
        shard = np.searchsorted(self.first, contexts, side="right") - 1
        cuts = np.searchsorted(shard, np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            part = slice(cuts[s], cuts[s + 1])
            trie, codes = (_mapped(p) for p in self.pairs[s])
            at, found = pair_places(trie, contexts[part] - self.first[s], words[part])
            seen = restored(codes["probabilities"][np.where(found, at, 0)])
            backed_off = restored(codes["backoff"][contexts[part] - self.first[s]]) + log10_word[part]
            out[part] = np.where(found, seen, backed_off)
        return out


def pair_places(trie: dict[str, np.ndarray], contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs in a shard's second level, and which of them are there; ``contexts`` must not fall."""
    pointers, values = EliasFano.open(trie, "pointers"), EliasFano.open(trie, "values")
    heads = np.flatnonzero(np.append(True, contexts[1:] != contexts[:-1]))
    each = np.diff(heads, append=len(contexts))
    own = contexts[heads]
    low, high = pointers.access(own).astype(np.int64), pointers.access(own + 1).astype(np.int64)
    base = np.where(low > 0, values.access(np.maximum(low - 1, 0)).astype(np.int64) + 1, 0)
    target = np.repeat(base, each) + words
    at = values.find(target.astype(np.uint64))
    inside = at < np.repeat(high, each)
    found = inside.copy()
    found[inside] = values.access(at[inside]).astype(np.int64) == target[inside]
    return np.where(found, at, 0), found


_files: dict[str, dict[str, np.ndarray]] = {}


def _mapped(path: str) -> dict[str, np.ndarray]:
    """A file's arrays, mapped once in each Python worker; files of other models are let go."""
    if path not in _files:
        folder = path.rsplit("/", 1)[0]
        for other in [p for p in _files if p.rsplit("/", 1)[0] != folder]:
            del _files[other]
        _files[path] = map_arrays(path)
    return _files[path]


def train(docs: DataFrame, folder: str) -> Model:
    """A model of all texts of ``docs``; its files go to ``folder`` (shared by all machines)."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 1 + int(size) // (6 * SHARD_TOKENS)
    model = _count_words(texts, folder, shards)
    if model.size:
        _count_pairs(texts, folder, model)
    return model


def _count_words(texts: DataFrame, folder: str, shards: int) -> Model:
    model = Model(shards, [None] * shards, np.zeros(shards + 1, np.int64), 0)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Tally(model.word_shard)
        for _, got in chunks(batches, _CHUNK):
            held.add(token_hashes(got)[0])
            if held.held > _HELD:
                yield from held.rows()
        yield from held.rows()

    def write(rows: pa.Table) -> pa.Table:
        shard, keys, counts = _unpacked(rows)
        path = write_arrays(folder, {"hashes": keys, "counts": counts})
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": [len(keys)], "tokens": [int(counts.sum())], "path": [path]})

    made = texts.mapInArrow(tally, _PACKED).groupBy("shard").applyInArrow(write, "shard int, n bigint, tokens bigint, path string")
    sizes = np.zeros(shards, np.int64)
    for r in settle(made, "lm-words").collect():  # a row for each shard
        sizes[r["shard"]], model.words[r["shard"]] = r["n"], r["path"]
        model.tokens += r["tokens"]
    model.first = np.append(0, np.cumsum(sizes))
    return model


def _count_pairs(texts: DataFrame, folder: str, model: Model) -> None:
    shared = texts.sparkSession.sparkContext.broadcast(model)
    wide = np.uint64(model.size)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        held = _Tally(lambda keys: np.searchsorted(known.first, (keys // wide).astype(np.int64), side="right") - 1)
        end = known.numbers(np.array([END], np.uint64))[0][0]
        for _, got in chunks(batches, _CHUNK):
            hashes, _ = token_hashes(got)
            words, place = np.unique(hashes, return_inverse=True)
            numbers = known.numbers(words)[0][place].astype(np.uint64)
            held.add(np.append(np.uint64(end), numbers[:-1]) * wide + numbers)
            if held.held > _HELD:
                yield from held.rows()
        yield from held.rows()

    def write(rows: pa.Table) -> pa.Table:
        shard, keys, counts = _unpacked(rows)
        known = shared.value
        contexts, words = (keys // wide).astype(np.int64) - known.first[shard], (keys % wide).astype(np.int64)
        n = int(known.first[shard + 1] - known.first[shard])
        each = np.bincount(contexts, minlength=n)
        pointers = np.append(0, np.cumsum(each))
        last = np.zeros(n, np.int64)
        last[each > 0] = words[pointers[1:][each > 0] - 1] + 1
        base = np.append(0, np.cumsum(last))[:-1]
        trie = EliasFano.build(pointers).parts("pointers") | EliasFano.build(base[contexts] + words).parts("values")
        path = write_arrays(folder, trie | {"counts": counts.astype(np.uint32)})
        # Leave-one-out likelihood of each strength: the occurrence that is predicted is taken out of the counts.
        prior = 10 ** known.log10_unigram(known.counts_of(words))
        total = np.bincount(contexts, counts, n)[contexts]
        fits = [float((counts * np.log((counts - 1 + s * prior) / (total - 1 + s))).sum()) for s in STRENGTHS]
        return pa.table({"shard": pa.array([shard], pa.int32()), "path": [path], "fits": pa.array([fits], pa.list_(pa.float64()))})

    made = texts.mapInArrow(tally, _PACKED).groupBy("shard").applyInArrow(write, "shard int, path string, fits array<double>")
    tries = settle(made, "lm-pairs").collect()  # a row for each shard
    model.strength = STRENGTHS[int(np.argmax(np.sum([r["fits"] for r in tries], axis=0)))]
    strength = model.strength

    def smooth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for shard, path in zip(column(batch, "shard").to_pylist(), column(batch, "path").to_pylist(), strict=True):
                trie = map_arrays(path)
                pointers = EliasFano.open(trie, "pointers")
                starts = pointers.access(np.arange(pointers.n)).astype(np.int64)
                each = np.diff(starts)
                counts = trie["counts"].astype(np.float64)
                values = EliasFano.open(trie, "values")
                rising = values.access(np.arange(values.n)).astype(np.int64)
                base = np.where(starts[:-1] > 0, rising[np.maximum(starts[:-1] - 1, 0)] + 1, 0)
                words = rising - np.repeat(base, each)
                contexts = np.repeat(np.arange(len(each)), each)
                total = np.bincount(contexts, counts, len(each))
                prior = 10 ** known.log10_unigram(known.counts_of(words))
                seen = np.log10((counts + strength * prior) / (total[contexts] + strength))
                codes = write_arrays(folder, {"probabilities": quantised(seen), "backoff": quantised(np.log10(strength / (total + strength)))})
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([path]), pa.array([codes])], names=["shard", "path", "codes"])

    spark = texts.sparkSession
    listed = spark.createDataFrame([(r["shard"], r["path"]) for r in tries], "shard int, path string").repartition(len(tries))
    model.pairs = [None] * model.shards
    for r in settle(listed.mapInArrow(smooth, "shard int, path string, codes string"), "lm-codes").collect():
        model.pairs[r["shard"]] = (r["path"], r["codes"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        end = known.numbers(np.array([END], np.uint64))[0][0]
        for batch, texts in chunks(batches, _CHUNK):
            hashes, starts = token_hashes(texts)
            words, place = np.unique(hashes, return_inverse=True)
            number, count = known.numbers(words)
            single = known.log10_unigram(count)
            numbers, alone = number[place], single[place]
            before = np.append(end, numbers[:-1])  # the end token stands before each text's first word
            value = alone.copy()
            after_known = np.flatnonzero(before >= 0)
            if len(after_known):
                # An unknown word has the number V here, which no context has among its successors.
                word = np.where(numbers >= 0, numbers, known.size)[after_known]
                wide = known.size + 1
                pairs, at, back = np.unique(before[after_known] * wide + word, return_index=True, return_inverse=True)
                value[after_known] = known.log10_pairs(pairs // wide, pairs % wide, alone[after_known][at])[back]
            add = lambda x: np.add.reduceat(x, starts[:-1])
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "doc_id"),
                    pa.array(np.diff(starts)),
                    pa.array(add((count > 0)[place].astype(np.int64))),
                    pa.array(np.full(len(texts), known.tokens, np.int64)),
                    pa.array(add(alone)),
                    pa.array(add(value)),
                ],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
