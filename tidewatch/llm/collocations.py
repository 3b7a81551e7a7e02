"""Phrase collocations: phrases of some words that occur often, and hold together more than their parts would by chance.

1. Words are counted by language; a word that is frequent enough gets a number. Texts become streams of
   these numbers, with a zero wherever a phrase cannot go on (a rare word, the end of a piece or text).
2. Level by level the candidates are those phrases that occur, whose first and last words without one are
   candidates too (Apriori: a phrase is never more frequent than its parts), and whose tally over all tasks reaches
   the minimum. Each level becomes a double array, in shards of bounded size by ranges of phrases, that every task can map.
3. All positions of a stream walk through the levels at once; the states they reach at each level are
   counted with ``bincount`` shard by shard, and Spark sums the counts over streams.
4. Each phrase is scored at its worst cut, phrases that mostly stand inside longer ones are dropped, and each
   language's best are ranked.

What the tasks share are files they map, because candidates grow with the corpus. A position belongs to
one shard of a level, so more shards do not mean more work. Words are told apart by 128 bits of hash.

Defined cases: null and empty texts have no words; a null language is ``und``; repeated rows count as often as they
occur; an empty table gives no rows; other columns are ignored; texts are read in runs of whole documents, a very
long one alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm import double_array
from tidewatch.llm.common import _LOWER, BYTE_VALUES, _powers_to, chunks, column, mix, settle
from tidewatch.llm.elias_fano import write_arrays
from tidewatch.llm.shards import each_shard, mapped, packed, unpacked, write_shards
from tidewatch.llm.tally import Tally

UNKNOWN_LANGUAGE = "und"
LEAST = 10
MAX_WORDS = 3
BEST = 2000
# A phrase goes if a longer candidate around it has so many hundredths of its occurrences.
INSIDE_PERCENT = 50
SCALE = 1_000_000
SHARD_WORDS = 500_000
SHARD_PHRASES = 200_000
STREAM_IDS = 500_000
_HELD_WORDS = 400_000
_TOP = 1 << 31

# Of bytes: 0 in a word, 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


def words_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, A-Z lowered, and which of them begin a piece."""
    data = _LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
    kind = _KIND[data]
    solid = np.flatnonzero(kind == 0)
    if not len(solid):
        return pa.array([], pa.binary()), np.zeros(0, bool)
    heads = np.flatnonzero(np.diff(solid, prepend=-2) > 1)
    pieces = np.cumsum(kind == 2)[solid[heads]]
    offsets = np.append(heads, len(solid)).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(offsets), pa.py_buffer(data[solid])])
    return found, np.diff(pieces, prepend=-1) != 0


def hashes(words: pa.Array, language: str) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each (not empty) word of a language."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    seed = np.uint64(int.from_bytes(language.encode("utf-8", "surrogatepass")[:8].ljust(8, b"\0"), "little"))
    for b in language.encode("utf-8", "surrogatepass"):
        seed = mix(np.array([seed + np.uint64(b + 1)]))[0]
    out = []
    with np.errstate(over="ignore"):
        powers = _powers_to(int(place.max()) + 1)[place]
        for turn in (np.uint8(0), np.uint8(0x5A)):
            out.append(mix(np.add.reduceat(BYTE_VALUES[data ^ turn] * powers, offsets[:-1]) + seed))
    return out[0], out[1]


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    for batch, texts in chunks(batches):
        groups: dict[str, list[bytes]] = {}
        for language, text in zip(column(batch, "lang").to_pylist(), texts, strict=True):
            groups.setdefault(language, []).append(text)
        for language, own in groups.items():
            words, begins = words_of(own)
            if len(words):
                yield language, words, begins


def _texts(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN_LANGUAGE))
    return docs.select(lang.alias("lang"), F.col("text").cast("string").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, times of all words; the row without a word has the number of all words of its language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.Table]] = {}
        totals: dict[str, int] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for language, tables in held.items():
                for part in pa.concat_tables(tables).combine_chunks().to_batches(50_000):
                    names = pa.array([language] * part.num_rows, pa.string())
                    yield pa.RecordBatch.from_arrays([names, part["word"].cast(pa.string()), part["times"]], names=["lang", "word", "times"])
            held.clear()

        def size() -> int:
            return sum(t.num_rows for tables in held.values() for t in tables)

        for language, words, _ in _by_language(batches):
            known = words.dictionary_encode()
            times = np.bincount(known.indices.to_numpy(), minlength=len(known.dictionary))
            held.setdefault(language, []).append(pa.table({"word": known.dictionary, "times": times}))
            totals[language] = totals.get(language, 0) + len(words)
            if size() > _HELD_WORDS:
                for key, tables in held.items():
                    summed = pa.concat_tables(tables).group_by("word").aggregate([("times", "sum")])
                    held[key] = [summed.rename_columns(["word", "times"] if summed.column_names[0] == "word" else ["times", "word"]).select(["word", "times"])]
                if size() > _HELD_WORDS // 2:
                    yield from rows()
        yield from rows()
        if totals:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(totals), pa.string()), pa.array([None] * len(totals), pa.string()), pa.array(list(totals.values()), pa.int64())],
                names=["lang", "word", "times"],
            )

    counted = _texts(docs).mapInArrow(run, "lang string, word string, times bigint")
    return counted.groupBy("lang", "word").agg(F.sum("times").alias("times"))


@dataclass
class Vocabulary:
    """Numbered words: where the shards' files are, and the first number of each shard (from 1; one more)."""

    paths: list[str | None]
    first: np.ndarray

    def shard_of(self, hashed: np.ndarray) -> np.ndarray:
        return ((hashed >> np.uint64(32)) * np.uint64(len(self.paths)) >> np.uint64(32)).astype(np.int64)

    def numbers(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Numbers of words given by their hashes; 0 if a word has none."""
        out = np.zeros(len(one), np.int64)
        for s, at in each_shard(self.shard_of(one)):
            if self.paths[s] is None:
                continue
            shard = mapped(self.paths[s])
            n = len(shard["one"])
            place = np.searchsorted(shard["one"], one[at])
            # Words with equal first hashes stand side by side, in order of the second.
            while True:
                inside = np.minimum(place, n - 1)
                more = (place < n) & (shard["one"][inside] == one[at]) & (shard["two"][inside] < two[at])
                if not more.any():
                    break
                place = place + more
            hit = (place < n) & (shard["one"][inside] == one[at]) & (shard["two"][inside] == two[at])
            out[at] = np.where(hit, place + self.first[s], 0)
        return out

    def _shards(self, numbers: np.ndarray) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]]:
        for s, at in each_shard(np.searchsorted(self.first, numbers, side="right") - 1):
            yield mapped(self.paths[s]), at, numbers[at] - self.first[s]

    def times(self, numbers: np.ndarray) -> np.ndarray:
        out = np.zeros(len(numbers), np.int64)
        for shard, at, own in self._shards(numbers):
            out[at] = shard["times"][own]
        return out

    def texts(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words and languages of numbers, as bytes."""
        words, languages = np.empty(len(numbers), object), np.empty(len(numbers), object)
        for shard, at, own in self._shards(numbers):
            words[at] = np.array(unpacked(shard, "word", own) + [None], object)[:-1]
            names = unpacked(shard, "langs", np.arange(len(shard["langs.ends"]) - 1))
            languages[at] = np.array(names + [None], object)[shard["lang"][own]]
        return words, languages


def write_vocabulary(words: DataFrame, folder: str) -> Vocabulary:
    """Files of the words (lang, word, times), which get numbers from 1."""
    shards = 1 + words.count() // SHARD_WORDS
    vocabulary = Vocabulary([None] * shards, np.ones(shards + 1, np.int64))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages = column(batch, "lang").to_pylist()
            texts = column(batch, "word").cast(pa.binary())
            one, two = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
            for language in set(languages):
                at = np.flatnonzero(np.array([x == language for x in languages]))
                one[at], two[at] = hashes(texts.take(pa.array(at)), language)
            yield pa.RecordBatch.from_arrays(
                [*(column(batch, n) for n in ("lang", "word", "times")), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(vocabulary.shard_of(one), pa.int32())],
                names=["lang", "word", "times", "one", "two", "shard"],
            )

    def make(rows: pa.Table) -> dict[str, np.ndarray]:
        one, two = (rows[n].to_numpy().view(np.uint64) for n in ("one", "two"))
        order = np.lexsort((two, one))
        names, lang = np.unique(np.array([x.encode() for x in rows["lang"].to_pylist()], object), return_inverse=True)
        texts = [t.encode() for t in rows["word"].to_pylist()]
        return {
            "one": one[order],
            "two": two[order],
            "times": rows["times"].to_numpy()[order],
            "lang": lang[order].astype(np.int32),
            **packed([texts[i] for i in order.tolist()], "word"),
            **packed(names.tolist(), "langs"),
        }

    placed = words.mapInArrow(place, "lang string, word string, times bigint, one bigint, two bigint, shard int")
    sizes = np.zeros(shards, np.int64)
    for s, (path, n) in write_shards(placed, folder, "phrase-words", make).items():
        vocabulary.paths[s], sizes[s] = path, n
    vocabulary.first = np.append(1, 1 + np.cumsum(sizes))
    if vocabulary.first[-1] >= _TOP:
        raise ValueError("more frequent words than numbers")
    return vocabulary


def streams(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """ids: streams of word numbers (32 bits each), with zeros where no phrase goes on."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).tobytes()], pa.binary())], names=["ids"])

        for language, words, begins in _by_language(batches):
            known = words.dictionary_encode()
            numbers = shared.value.numbers(*hashes(known.dictionary, language))
            ids = np.append(np.insert(numbers[known.indices.to_numpy()], np.flatnonzero(begins), 0), 0)
            ids = ids[(ids != 0) | (np.append(1, ids[:-1]) != 0)].astype(np.uint32)
            held.append(ids)
            size += len(ids)
            if size >= STREAM_IDS:
                yield row()
                held, size = [], 0
        if held:
            yield row()

    return _texts(docs).mapInArrow(run, "ids binary")


@dataclass
class Level:
    """The phrases of one length as shards of a double array, in order of (state before, last word)."""

    paths: list[str]
    keys: np.ndarray  # the first of each shard
    first: np.ndarray  # number of the first phrase of each shard (one more)

    def step(self, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Numbers of the phrases that ``words`` make of phrases (or words) ``states``; -1 where there is none."""
        out = np.full(len(states), -1, np.int64)
        if not self.paths:
            return out
        shard = np.searchsorted(self.keys, states << 32 | words, side="right") - 1
        for s, at in each_shard(np.maximum(shard, 0)):
            found = double_array.step(mapped(self.paths[s]), states[at], words[at])
            out[at] = np.where(found >= 0, found + self.first[s], -1)
        return out

    def count(self, states: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """How often each phrase is among ``states``: numbers and counts, shard by shard."""
        for s, at in each_shard(np.searchsorted(self.first, states, side="right") - 1):
            times = np.bincount(states[at] - self.first[s], minlength=int(self.first[s + 1] - self.first[s]))
            seen = np.flatnonzero(times)
            yield seen + self.first[s], times[seen]

    def parts(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state before and the last word of phrases."""
        keys = np.zeros(len(numbers), np.int64)
        for s, at in each_shard(np.searchsorted(self.first, numbers, side="right") - 1):
            keys[at] = mapped(self.paths[s])["keys"][numbers[at] - self.first[s]]
        return keys >> 32, keys & 0xFFFFFFFF


def write_level(keys: DataFrame, folder: str, most: int = SHARD_PHRASES) -> Level:
    """Double arrays of the candidates (one column, ``key``: state before << 32 | last word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            own = np.concatenate(held)
            path = write_arrays(folder, double_array.build(own >> 32, own & 0xFFFFFFFF) | {"keys": own})
            return pa.RecordBatch.from_arrays([pa.array([own[0]]), pa.array([path]), pa.array([len(own)], pa.int64())], names=["key", "path", "n"])

        for batch in batches:
            held.append(column(batch, "key").to_numpy())
            size += batch.num_rows
            if size >= most:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    ordered = keys.select("key").repartitionByRange("key").sortWithinPartitions("key")
    made = settle(ordered.mapInArrow(run, "key bigint, path string, n bigint"), "phrase-shards").orderBy("key").collect()
    level = Level([r["path"] for r in made], np.array([r["key"] for r in made], np.int64), np.cumsum([0] + [r["n"] for r in made]))
    if level.first[-1] >= _TOP:
        raise ValueError("more phrases than numbers")
    return level


def walk(levels: list[Level], ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Level by level the places (of first words) that stand on a phrase, and the numbers of these phrases.

    The first pair is the words themselves.
    """
    places = np.flatnonzero(ids)
    states = ids[places].astype(np.int64)
    yield places, states
    for depth, level in enumerate(levels, 1):
        inside = places + depth < len(ids)
        places, states = places[inside], states[inside]
        words = ids[places + depth].astype(np.int64)
        go = np.flatnonzero(words)
        states = level.step(states[go], words[go])
        hit = states >= 0
        places, states = places[go][hit], states[hit]
        yield places, states


def candidates(texts: DataFrame, levels: list[Level], least: int) -> DataFrame:
    """key: the candidates that are one word longer than those of the last level (or than words)."""
    shared = texts.sparkSession.sparkContext.broadcast(levels)
    depth = len(levels) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Tally()
        for batch in batches:
            for blob in column(batch, "ids"):
                ids = np.frombuffer(blob.as_buffer(), np.uint32)
                *_, (places, states) = walk(shared.value, ids)
                # Both shorter phrases stand here: this one, and the one a word later.
                later = np.searchsorted(places, places + 1)
                ok = np.flatnonzero(np.append(places, -1)[later] == places + 1)
                held.add(states[ok] << 32 | ids[places[ok] + depth].astype(np.int64))
                yield from held.full()
        yield from held.rest()

    return texts.mapInArrow(run, Tally.SCHEMA).groupBy("key").agg(F.sum("times").alias("times")).where(F.col("times") >= least).select("key")


def phrase_counts(texts: DataFrame, levels: list[Level]) -> DataFrame:
    """level (from 0), number, times of all candidates that occur, by walking all streams through all levels."""
    shared = texts.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Tally()
        for batch in batches:
            for blob in column(batch, "ids"):
                reached = walk(shared.value, np.frombuffer(blob.as_buffer(), np.uint32))
                next(reached)
                for i, (level, (_, states)) in enumerate(zip(shared.value, reached, strict=True)):
                    for numbers, times in level.count(states):
                        held.add(numbers | i << 40, times)
                yield from held.full()
        yield from held.rest()

    counted = texts.mapInArrow(run, Tally.SCHEMA).groupBy("key").agg(F.sum("times").alias("times"))
    return counted.select(F.shiftright("key", 40).cast("int").alias("level"), (F.col("key") % (1 << 40)).alias("number"), "times")


@dataclass
class Counts:
    """Counts of phrases by level and number, as files of ``size`` counts each."""

    paths: list[dict[int, str]]
    size: int

    def times(self, level: int, numbers: np.ndarray) -> np.ndarray:
        out = np.zeros(len(numbers), np.int64)
        for s, at in each_shard(numbers // self.size):
            out[at] = mapped(self.paths[level][s])["times"][numbers[at] - s * self.size]
        return out


def write_counts(counts: DataFrame, levels: int, folder: str, size: int = SHARD_PHRASES) -> Counts:
    def make(rows: pa.Table) -> dict[str, np.ndarray]:
        times = np.zeros(size, np.int64)
        times[rows["number"].to_numpy() % size] = rows["times"].to_numpy()
        return {"times": times}

    out = Counts([{} for _ in range(levels)], size)
    placed = counts.withColumn("shard", (F.expr(f"number div {size}") * levels + F.col("level")).cast("int"))
    for s, (path, _) in write_shards(placed, folder, "phrase-times", make).items():
        out.paths[s % levels][s // levels] = path
    return out


_SCORED = "level int, number bigint, lang string, phrase string, a bigint, l bigint, r bigint, score bigint, head bigint, tail bigint"


def scored(counts: DataFrame, vocabulary: Vocabulary, levels: list[Level], times: Counts) -> DataFrame:
    """Every phrase with its text, its worst cut (l, r, score), and the numbers of its first and last words without one."""
    shared = counts.sparkSession.sparkContext.broadcast((vocabulary, levels, times))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, trie, often = shared.value

        def occurrences(states: np.ndarray, words: int) -> np.ndarray:
            return known.times(states) if words == 1 else often.times(words - 2, states)

        for batch in batches:
            of = column(batch, "level").to_numpy()
            for level in np.unique(of).tolist():
                at = np.flatnonzero(of == level)
                numbers, a = (column(batch, n).to_numpy()[at] for n in ("number", "times"))
                n = level + 2
                # heads[k]: the state of the first k + 1 words; then the words themselves.
                heads, words = [numbers], []
                for i in range(level, -1, -1):
                    before, word = trie[i].parts(heads[0])
                    heads.insert(0, before)
                    words.insert(0, word)
                words.insert(0, heads[0])
                best = None
                tails = []
                for k in range(1, n):
                    tail = words[k]
                    for j in range(k + 1, n):
                        tail = trie[j - k - 1].step(tail, words[j])
                    tails.append(tail)
                    left, right = occurrences(heads[k - 1], k), occurrences(tail, n - k)
                    # Whole numbers of any size; the products may pass 64 bits.
                    got = [SCALE * x * x // (y * z) for x, y, z in zip(a.tolist(), left.tolist(), right.tolist(), strict=True)]
                    got = np.array(got, np.int64)
                    if best is None:
                        best, l_best, r_best = got, left, right
                    else:
                        less = got < best
                        best, l_best, r_best = (np.where(less, x, y) for x, y in ((got, best), (left, l_best), (right, r_best)))
                texts = [known.texts(w) for w in words]
                phrases = [b" ".join(t).decode() for t in zip(*(t for t, _ in texts), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(of[at], pa.int32()),
                        pa.array(numbers),
                        pa.array([x.decode() for x in texts[0][1]], pa.string()),
                        pa.array(phrases, pa.string()),
                        pa.array(a),
                        pa.array(l_best),
                        pa.array(r_best),
                        pa.array(best),
                        pa.array(heads[n - 2]),
                        pa.array(tails[0]),
                    ],
                    names=["level", "number", "lang", "phrase", "a", "l", "r", "score", "head", "tail"],
                )

    return counts.mapInArrow(run, _SCORED)


def ranked(phrases: DataFrame, totals: DataFrame, best: int = BEST, inside_percent: int = INSIDE_PERCENT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases, those inside longer ones left out.

    A longer candidate two words longer has a part that is one word longer, at least as frequent and a candidate too, so
    looking one word further is enough.
    """
    around = (
        phrases.where("level > 0")
        .select((F.col("level") - 1).alias("level"), F.explode(F.array("head", "tail")).alias("number"), "a")
        .groupBy("level", "number")
        .agg(F.max("a").alias("longer"))
    )
    kept = phrases.join(around, ["level", "number"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside_percent * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The best of each part of a language first, so that no task sorts a whole language.
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    some = kept.withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= best).drop("rank")
    final = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)
    return final.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations(
    docs: DataFrame, folder: str, max_words: int = MAX_WORDS, least: int = LEAST, best: int = BEST, shard_phrases: int = SHARD_PHRASES
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``best`` phrases of 2 to ``max_words`` words of each language."""
    counted = settle(word_counts(docs).where((F.col("times") >= least) | F.col("word").isNull()), "phrase-word-counts")
    totals = counted.where(F.col("word").isNull()).select("lang", F.col("times").alias("n"))
    vocabulary = write_vocabulary(counted.where(F.col("word").isNotNull() & (F.col("times") >= least)), folder)
    texts = settle(streams(docs, vocabulary), "phrase-streams")
    levels: list[Level] = []
    while len(levels) < max_words - 1:
        levels.append(write_level(candidates(texts, levels, least), folder, shard_phrases))
    counts = settle(phrase_counts(texts, levels).where(F.col("times") >= least), "phrase-counts")
    times = write_counts(counts, len(levels), folder, shard_phrases)
    return ranked(settle(scored(counts, vocabulary, levels, times), "phrases"), totals, best)
