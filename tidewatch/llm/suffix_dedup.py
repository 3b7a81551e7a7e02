"""Suffix-array dedup: every byte covered by a 400-byte string that also starts anywhere else goes.

A *window* is a string of ``WINDOW`` bytes (or as many as asked for) at some place of a text. Sorting all suffixes of
a corpus in one array needs it all in one place, so windows are first parted, exactly:

1. Each window has a key, the least hash of the grams in it (64 bytes each, fewer in short windows). Equal windows have
   equal keys. Neighbouring windows mostly share theirs, so a text falls into segments (runs
   of windows with one key), about one for every 170 bytes. Only segments are shuffled.
2. A key that one segment has alone is done, unless the key's gram stands in it twice (then
   it may repeat itself, and goes on). If all segments of a key
   have equal bytes, all their windows repeat.
3. For the other keys the different segments' bytes are fetched, one copy of each, and keys
   are put into batches of bounded size. A batch is sorted by two-stage suffix sorting:
   only suffixes smaller than their successors are sorted directly, the rest is induced by
   one scan over the buckets of first bytes. Neighbours in the array whose common prefix
   has WINDOW bytes are repeated windows.
4. A key with more than ``WIDE`` different segments (text that very many documents have,
   each with other words around it) never meets in one task: its windows are counted
   one by one, by 128-bit hashes, and looked up in the files of those that repeat. Equal windows that a task meets
   travel once, so a window that stands everywhere (or over and over in one text) is a few entries for each task.

Defined cases: null and empty texts have no bytes; texts shorter than a window lose
nothing; equal rows are copies of each other; a null doc_id is a document like others in
the report; rows that share an id are told apart by their text; extra columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewatch.llm.common import BYTE_VALUES, chunks, column, encoded, mix, settle
from tidewatch.llm.shards import each_shard, mapped, write_shards
from tidewatch.session import scratch_path

WINDOW = 400


def gram_size(window: int) -> int:
    """Bytes of the grams whose hashes key windows: 64 of the standard window, fewer of short ones, so that segments stay long."""
    return max(1, min(64, window * 4 // 15))


# A run of windows with one key is cut after so many.
LONGEST_RUN = 1024
# Bytes sorted at once, and the most different segments of a key that are sorted together.
BATCH_BYTES = 60_000
WIDE = 400
# Windows of wide keys for each shard of their hashes, about.
SHARD_WINDOWS = 2_000_000
_CHUNK = 500_000


# Two-stage suffix sorting


def suffix_array(data: bytes, depth: int = WINDOW) -> np.ndarray:
    """Starts of all suffixes in order of their first ``depth`` bytes, which is all that is compared.

    Two-stage sorting: suffixes that are smaller than the one that follows them (type B)
    are sorted directly. All others (type A) follow from one scan over the buckets of first
    bytes in rising order: the predecessors of a bucket's suffixes, in its order, are the type
    A suffixes of their own buckets, in theirs. Within a bucket type A stands before type B.
    """
    n = len(data)
    t = np.frombuffer(data, np.uint8)
    if not n:
        return np.zeros(0, np.int64)
    # Type B: the next different byte is larger. The last suffix is larger than the empty one.
    rise = np.zeros(n, np.int8)
    rise[:-1] = np.sign(t[1:].astype(np.int16) - t[:-1])
    rise[-1] = -1
    where = np.where(rise != 0, np.arange(n), n)
    nearest = np.minimum.accumulate(where[::-1])[::-1]
    small = rise[nearest] > 0
    direct = np.flatnonzero(small)
    order = sorted(direct.tolist(), key=lambda i: data[i : i + depth])
    order = np.array(order, np.int64)
    first = t[order] if len(order) else np.zeros(0, np.uint8)
    cuts = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[t[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        rounds = []
        part = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        while len(part):
            rounds.append(part)
            before = part[part > 0] - 1
            part = before[t[before] == c]
        bucket = np.concatenate([*rounds, order[cuts[c] : cuts[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[~small[before] & (t[before] > c)]
        if len(before):
            head = t[before]
            by = np.argsort(head, kind="stable")
            before, head = before[by], head[by]
            for at in np.split(np.arange(len(head)), np.flatnonzero(np.diff(head)) + 1):
                waiting[head[at[0]]].append(before[at])
    return np.concatenate(out)


def common_prefixes(data: bytes, order: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """For each neighbouring pair in ``order`` the length of their common prefix, counted in eights up to ``depth``.

    All suffixes in ``order`` must have ``depth`` bytes. Exact for the question whether it reaches ``depth``.
    """
    padded = np.frombuffer(data + b"\0" * 8, np.uint8)
    words = np.lib.stride_tricks.as_strided(padded[: len(data) + 1].view(), (len(data) + 1, 8), (1, 1))
    a, b = order[:-1], order[1:]
    length = np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    for at in range(0, depth, 8):
        size = min(8, depth - at)
        same = (words[a[open_] + at, :size] == words[b[open_] + at, :size]).all(1)
        open_ = open_[same]
        if not len(open_):
            break
        length[open_] = at + size
    return length


def repeated_starts(data: bytes, starts: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """Which of ``starts`` (places with ``depth`` bytes after them) begin a string that another of them begins too."""
    if len(starts) < 2:
        return np.zeros(0, np.int64)
    wanted = np.zeros(len(data) + 1, bool)
    wanted[starts] = True
    order = suffix_array(data, depth)
    order = order[wanted[order]]
    same = common_prefixes(data, order, depth) >= depth
    return np.sort(order[np.append(same, False) | np.insert(same, 0, False)])


# Segments


_MULTIPLIERS = mix(np.arange(31, 41, dtype=np.uint64)) | np.uint64(1)


def _grown_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all strings of ``length`` bytes, by doubling."""
    with np.errstate(over="ignore"):
        size, values, total, done = 1, BYTE_VALUES[data], None, 0
        level = 0
        while True:
            if length & size:
                total = values if total is None else total[: len(total) - size] * _MULTIPLIERS[level] + values[done : done + len(total) - size]
                done += size
            if done == length:
                return mix(total)
            values = values[:-size] * _MULTIPLIERS[level] + values[size:]
            size *= 2
            level += 1


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by doubling."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


def segments(texts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Of all texts: index of the text, key, first window, number of windows of each segment, and
    whether it may repeat itself (its key's gram stands in it twice)."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    none = np.zeros(0, np.int64)
    nothing = none, none.astype(np.uint64), none, none, none.astype(bool)
    if len(data) < window:
        return nothing
    gram = gram_size(window)
    width = window - gram + 1
    grams = _grown_hashes(data, gram)
    keys = _sliding_least(grams, width)
    # A gram is the least of some window if the largest key of the windows around it is its hash.
    around = ~_sliding_least(np.concatenate([np.full(width - 1, ~np.uint64(0)), ~keys, np.full(width - 1, ~np.uint64(0))]), width)
    chosen = np.flatnonzero(around[: len(grams)] == grams)
    twice = chosen[:-1][(grams[chosen[1:]] == grams[chosen[:-1]]) & (np.diff(chosen) < LONGEST_RUN + width)]
    ends = np.cumsum(sizes)
    begins = ends - sizes
    text = np.repeat(np.arange(len(texts)), sizes)[: len(keys)]
    place = np.arange(len(keys)) - begins[text]
    inside = np.flatnonzero(place + window <= sizes[text])
    if not len(inside):
        return nothing
    firsts = inside
    keys, text, place = keys[inside], text[inside], place[inside]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
    heads = np.flatnonzero(new)
    runs = np.diff(heads, append=len(keys))
    if runs.max() > LONGEST_RUN:
        extra = -(-runs // LONGEST_RUN)
        steps = np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra)
        heads = np.repeat(heads, extra) + steps * LONGEST_RUN
        runs = np.diff(heads, append=len(keys))
    inner = np.searchsorted(twice, firsts[heads]) < np.searchsorted(twice, firsts[heads] + runs + width - 1)
    return text[heads], keys[heads], place[heads], runs, inner


# A row is known by its doc_id and a hash of its text, so rows without an id of their own stay apart.
_ROW = ["doc_id", "text_hash"]


def _same_row(rows: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """Join with a table whose row columns are called ``of_doc`` and ``of_text``, which are dropped."""
    on = rows["doc_id"].eqNullSafe(other["of_doc"]) & (rows["text_hash"] == other["of_text"])
    return rows.join(other, on, how).drop("of_doc", "of_text")


def _rows(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("text_hash", F.xxhash64("text"))


def _segment_rows(rows: DataFrame, window: int) -> DataFrame:
    """doc_id, text_hash, key, content (a hash of the segment's bytes), first, windows, inner of every segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, _CHUNK):
            text, keys, first, windows, inner = segments(texts, window)
            content = [
                hashlib.blake2b(texts[t][f : f + w + window - 1], digest_size=8).digest()
                for t, f, w in zip(text.tolist(), first.tolist(), windows.tolist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    *(column(batch, n).take(pa.array(text)) for n in _ROW),
                    pa.array(keys.view(np.int64)),
                    pa.array(np.frombuffer(b"".join(content), np.int64)),
                    pa.array(first, pa.int32()),
                    pa.array(windows, pa.int32()),
                    pa.array(inner),
                ],
                names=[*_ROW, "key", "content", "first", "windows", "inner"],
            )

    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, key bigint, content bigint, first int, windows int, inner boolean")


def _fetched(rows: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """key, content, wide, bytes of the wanted segments (of_doc, of_text, key, content, first, windows, wide)."""
    lists = wanted.groupBy("of_doc", "of_text").agg(F.collect_list(F.struct("key", "content", "first", "windows", "wide")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, parts in zip(encoded(column(batch, "text").to_pylist()), column(batch, "wanted").to_pylist(), strict=True):
                for p in parts:
                    out.append((p["key"], p["content"], p["wide"], text[p["first"] : p["first"] + p["windows"] + window - 1]))
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["key", "content", "wide", "bytes"])

    found = _same_row(rows, lists, "inner").select("text", "wanted")
    return found.mapInArrow(run, "key bigint, content bigint, wide boolean, bytes binary")


_RUNS = "array<struct<at:int,windows:int>>"
_RUNS_KIND = pa.list_(pa.struct([("at", pa.int32()), ("windows", pa.int32())]))


def _runs(places: np.ndarray) -> list[dict]:
    heads = np.flatnonzero(np.diff(places, prepend=-2) > 1)
    sizes = np.diff(heads, append=len(places))
    return [{"at": a, "windows": w} for a, w in zip(places[heads].tolist(), sizes.tolist(), strict=True)]


def _sorted_batches(parts: DataFrame, window: int) -> DataFrame:
    """key, content, runs: the repeated windows of segments, found by suffix sorting within keys."""

    def work(held: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        ends = np.cumsum([len(b) for _, _, b in held])
        begins = ends - [len(b) for _, _, b in held]
        starts = np.concatenate([np.arange(a, e - window + 1) for a, e in zip(begins, ends, strict=True)])
        again = repeated_starts(b"".join(b for _, _, b in held), starts, window)
        cuts = np.searchsorted(again, np.append(begins, ends[-1]))
        rows = [(k, c, _runs(again[x:y] - a)) for (k, c, _), a, x, y in zip(held, begins, cuts[:-1], cuts[1:], strict=True) if y > x]
        cols = list(zip(*rows, strict=True)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], _RUNS_KIND)], names=["key", "content", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size = 0
        for batch in batches:
            for row in zip(*(column(batch, n).to_pylist() for n in ("key", "content", "bytes")), strict=True):
                # Keys stay whole; a key has WIDE segments at most.
                if size >= BATCH_BYTES and held and held[-1][0] != row[0]:
                    yield work(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield work(held)

    return parts.repartition("key").sortWithinPartitions("key").mapInArrow(run, f"key bigint, content bigint, runs {_RUNS}")


_WINDOW = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("n", "<i8")])
_WINDOW_RUNS = f"key bigint, content bigint, runs {_RUNS}"


def _window_hashes(data: bytes, window: int) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(data, np.uint8)
    return _grown_hashes(a, window), _grown_hashes(a ^ np.uint8(0x5A), window)


def _window_counts(one: np.ndarray, two: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The different windows in order, with the sums of their counts."""
    order = np.lexsort((two, one))
    one, two, n = one[order], two[order], n[order]
    heads = np.flatnonzero(np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
    out = np.zeros(len(heads), _WINDOW)
    out["h1"], out["h2"], out["n"] = one[heads], two[heads], np.add.reduceat(n, heads)
    return out


def _counted_windows(parts: DataFrame, window: int) -> DataFrame:
    """The same for keys with very many different segments: each window by itself, counted by hash.

    The different windows that a task meets in a batch travel in one packed row for each shard of hashes; those that stand in
    two places become sorted files, which the segments' tasks map and look their windows up in.
    """
    total = parts.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    spark = parts.sparkSession
    if not total:
        return spark.createDataFrame([], _WINDOW_RUNS)
    shards = 1 + int(total) // SHARD_WINDOWS
    shard_of = lambda one: ((one >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_window_hashes(data, window) for data in column(batch, "bytes").to_pylist()]
            if not got:
                continue
            one, two = (np.concatenate(x) for x in zip(*got, strict=True))
            counts = _window_counts(one, two, np.ones(len(one), np.int64))
            cuts = np.searchsorted(shard_of(counts["h1"]), np.arange(shards + 1))
            own = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int32()), pa.array([counts[cuts[s] : cuts[s + 1]].tobytes() for s in own], pa.binary())], names=["shard", "windows"]
            )

    def make(rows: pa.Table) -> dict[str, np.ndarray]:
        got = np.concatenate([np.frombuffer(x.as_buffer(), _WINDOW) for x in rows["windows"]])
        counts = _window_counts(got["h1"], got["h2"], got["n"])
        counts = counts[counts["n"] > 1]
        return {"h1": np.ascontiguousarray(counts["h1"]), "h2": np.ascontiguousarray(counts["h2"])}

    paths = write_shards(parts.mapInArrow(count, "shard int, windows binary"), scratch_path(spark, "suffix-windows"), "suffix-window-shards", make)

    def repeated(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        out = np.zeros(len(one), bool)
        for s, at in each_shard(shard_of(one)):
            known = mapped(paths[s][0])
            n = len(known["h1"])
            place = np.searchsorted(known["h1"], one[at])
            open_ = np.flatnonzero(place < n)
            while len(open_):  # windows with equal first hashes stand side by side
                open_ = open_[known["h1"][place[open_]] == one[at[open_]]]
                hit = known["h2"][place[open_]] == two[at[open_]]
                out[at[open_[hit]]] = True
                open_ = open_[~hit]
                place[open_] += 1
                open_ = open_[place[open_] < n]
        return out

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_window_hashes(data, window) for data in column(batch, "bytes").to_pylist()]
            if not got:
                continue
            ends = np.cumsum([0] + [len(one) for one, _ in got])
            again = repeated(*(np.concatenate(x) for x in zip(*got, strict=True)))
            runs = [_runs(np.flatnonzero(again[a:b])) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            own = pa.array([i for i, r in enumerate(runs) if r], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [column(batch, "key").take(own), column(batch, "content").take(own), pa.array([r for r in runs if r], _RUNS_KIND)], names=["key", "content", "runs"]
            )

    return parts.mapInArrow(look_up, _WINDOW_RUNS)


def repeated_spans(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """of_doc, of_text and the spans [first, last) of bytes to remove, of the rows (doc_id, text, text_hash) that have some.

    Spans of a row may overlap; there are at most as many as the row has segments and runs in them.
    """
    found = settle(_segment_rows(rows, window), "suffix-segments")
    keys = (
        found.groupBy("key")
        .agg(F.count("*").alias("times"), F.min("content").alias("low"), F.max("content").alias("high"), F.max("inner").alias("inner"))
        .where("times > 1 OR inner")
        .select("key", ((F.col("low") == F.col("high")) & (F.col("times") > 1)).alias("equal"))
    )
    open_ = settle(found.drop("inner").join(keys, "key"), "suffix-open")
    mixed = open_.where("NOT equal")
    one = F.min(F.struct("doc_id", "text_hash", "first", "windows"))
    different = settle(mixed.groupBy("key", "content").agg(F.count("*").alias("times"), one.alias("one")), "suffix-different")
    # Settled, so that Spark knows how small it is (at most one row for WIDE rows of ``different``).
    wide = settle(different.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > WIDE).select("key", F.lit(True).alias("is_wide")), "suffix-wide")
    wanted = different.join(wide, "key", "left").select(
        "key",
        "content",
        F.col("one.doc_id").alias("of_doc"),
        F.col("one.text_hash").alias("of_text"),
        "one.first",
        "one.windows",
        F.coalesce("is_wide", F.lit(False)).alias("wide"),
    )
    parts = settle(_fetched(rows, wanted, window), "suffix-bytes")
    runs = _sorted_batches(parts.where("NOT wide"), window).unionByName(_counted_windows(parts.where("wide"), window))
    # All windows of a segment with a twin repeat, whatever else does.
    whole = different.where("times > 1").select("key", "content", F.lit(True).alias("twin"))
    verdict = settle(runs.join(whole, ["key", "content"], "full"), "suffix-verdict")

    def span(at: Column, windows: Column) -> Column:
        first = F.col("first") + at
        return F.struct(first.alias("first"), (first + windows + window - 1).alias("last"))

    all_windows = F.array(span(F.lit(0), F.col("windows")))
    some_windows = F.transform("runs", lambda r: span(r["at"], r["windows"]))
    spans = mixed.join(verdict, ["key", "content"]).select(*_ROW, F.when(F.col("twin"), all_windows).otherwise(some_windows).alias("spans"))
    return (
        open_.where("equal")
        .select(*_ROW, all_windows.alias("spans"))
        .unionByName(spans)
        .groupBy(F.col("doc_id").alias("of_doc"), F.col("text_hash").alias("of_text"))
        .agg(F.flatten(F.collect_list("spans")).alias("spans"))
    )


def kept_bytes(text: bytes, spans: list[tuple[int, int]], min_words: int = 0) -> tuple[bytes, int]:
    """The bytes outside all spans, and how many separate runs were removed. Runs of fewer than ``min_words`` words stay."""
    joined: list[list[int]] = []
    for a, b in sorted(spans):
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(b, joined[-1][1])
        else:
            joined.append([a, b])
    joined = [(a, b) for a, b in joined if not min_words or len(text[a:b].split()) >= min_words]
    edges = [0, *(e for run in joined for e in run), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), len(joined)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = _rows(docs)
    joined = _same_row(rows, repeated_spans(rows), "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(encoded(column(batch, "text").to_pylist()), column(batch, "spans").to_pylist(), strict=True):
                kept, runs = kept_bytes(text, [(s["first"], s["last"]) for s in spans or []])
                out.append((len(text), len(text) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = WINDOW, min_words: int = 0) -> DataFrame:
    """The documents with the repeated passages cut out of ``text``, all columns, and ``n_chars`` (if there) anew.

    A passage is a run of repeated windows; one of fewer than ``min_words`` words stays.
    Bytes of a character that is cut through go with it.
    """
    spans = repeated_spans(_rows(docs), window)
    taken = {c.lower() for c in docs.columns}
    name, doc, hashed_text = (next(n for n in (base + "_" * i for i in range(len(taken) + 1)) if n not in taken) for base in ("spans", "of_doc", "of_text"))
    hashed = F.xxhash64(F.col("text").cast("string"))
    on = F.col("doc_id").cast("bigint").eqNullSafe(F.col(doc)) & (hashed == F.col(hashed_text))
    spans = spans.select(F.col("of_doc").alias(doc), F.col("of_text").alias(hashed_text), F.col("spans").alias(name))
    joined = docs.join(spans, on, "left").select(*(docs[c] for c in docs.columns), spans[name])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            given = column(batch, "text").to_pylist()
            for text, old, cut in zip(given, encoded(given), column(batch, name).to_pylist(), strict=True):
                if text is not None and cut:
                    text = kept_bytes(old, [(s["first"], s["last"]) for s in cut], min_words)[0].decode("utf-8", "ignore")
                texts.append(text)
            made = {"text": pa.array(texts, pa.string()), "n_chars": [None if t is None else len(t) for t in texts]}
            yield pa.RecordBatch.from_arrays(
                [pa.array(made[f.name], f.type) if f.name in made else column(batch, f.name) for f in batch.schema if f.name != name],
                names=[f.name for f in batch.schema if f.name != name],
            )

    return joined.mapInArrow(run, StructType(docs.schema))
