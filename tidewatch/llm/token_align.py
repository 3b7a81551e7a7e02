"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and which pairs of ids overlap most.

Both tokenizers cut the same bytes (a blank and the text), so the ends of their tokens are two rising lists.
Their common values are found by galloping: each end of the shorter list is looked for in the longer one from
the last place that is sure to be common, by steps of doubling size and then by halving. The common ends
slice both lists into groups. How many ends lie below a token's first and last byte (a difference of ranks) gives
the range of tokens that overlap it: the links. All this happens once for each different part of a text
at whose edges both tokenizers start anew (see ``parts``); numpy gallops in all new parts at once.

Links are counted over the corpus by pair of ids. The table of pairs is cut into shards by ranges of
pairs, written as files that the tasks map into memory. Its size is bounded by the two vocabularies, not by the
corpus, and no task holds more of it than it looks up.

Defined cases: null and empty texts have no tokens, nor do texts whose tokens' bytes are not those of the text (such as
a text with U+2581, which one tokenizer reads as a blank): all numbers are 0, the groups' string is empty. Repeated
rows count as often as they occur, null ids are kept; an empty table gives no rows; other columns are ignored.
Strings of special tokens inside a text are plain text. Very long texts are cut and joined in one task, part by part.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import chunks, column, settle
from tidewatch.llm.parts import ByteLevel, Cut, Known, cut
from tidewatch.llm.shards import each_shard, mapped, write_shards
from tidewatch.llm.tally import Tally

_CHUNK = 4_000_000
# There are as many shards of pairs as the possible pairs fill with so many each; pairs are dealt by a hash.
SHARD_PAIRS = 1 << 22


def gallop(wanted: np.ndarray, rising: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Which of ``wanted`` are among ``rising[start:stop]`` (per value; ``rising[stop - 1]`` is not below the value).

    All values gallop at once: steps of doubling size while the place is below the value, then halving.
    """
    low, step = start.copy(), np.ones(len(start), np.int64)
    open_ = np.flatnonzero(rising[low] < wanted) if len(low) else np.zeros(0, np.int64)
    while len(open_):
        ahead = np.minimum(low[open_] + step[open_], stop[open_] - 1)
        below = rising[ahead] < wanted[open_]
        low[open_[below]] = ahead[below]
        open_ = open_[below]
        step[open_] *= 2
    high = np.minimum(low + step, stop - 1)
    # rising[low] < wanted <= rising[high], or the value is at the start.
    open_ = np.flatnonzero(high - low > 1)
    while len(open_):
        middle = (low[open_] + high[open_]) // 2
        below = rising[middle] < wanted[open_]
        low[open_[below]] = middle[below]
        high[open_[~below]] = middle[~below]
        open_ = open_[high[open_] - low[open_] > 1]
    return (rising[low] == wanted) | (rising[high] == wanted)


def common_ends(a: np.ndarray, b: np.ndarray, a_starts: np.ndarray, b_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which ends of ``a`` and which of ``b`` are common. Both rise, over parts whose own ends begin at ``a_starts``
    and ``b_starts`` (one more each); the last end of a part is common. The shorter list of each part drives."""
    part_a, part_b = np.diff(a_starts), np.diff(b_starts)
    at_a, at_b = np.zeros(len(a) + 1, bool), np.zeros(len(b) + 1, bool)
    for short, long, short_starts, long_starts, drives, out, other in (
        (a, b, a_starts, b_starts, part_a <= part_b, at_a, at_b),
        (b, a, b_starts, a_starts, part_b < part_a, at_b, at_a),
    ):
        each = np.diff(short_starts)
        own = np.flatnonzero(np.repeat(drives, each))
        part = np.repeat(np.arange(len(each)), each)[own]
        hit = own[gallop(short[own], long, long_starts[:-1][part], long_starts[1:][part])]
        out[hit] = True
        other[np.searchsorted(long, short[hit])] = True
    return at_a[:-1], at_b[:-1]


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (token of a, token of b) whose byte ranges overlap; ``a`` and ``b`` are the ends of tokens of
    the same bytes. A difference of ranks is the number of partners."""
    first = np.searchsorted(a, np.concatenate([[0], b[:-1]]), side="right")
    last = np.searchsorted(a, b, side="left")
    many = last - first + 1
    of_b = np.repeat(np.arange(len(b)), many)
    steps = np.arange(len(of_b)) - np.repeat(np.cumsum(many) - many, many)
    return first[of_b] + steps, of_b


def _digits(size: int) -> np.ndarray:
    """Decimal digits of the numbers below ``size``, zero bytes behind."""
    width = len(str(max(size - 1, 0)))
    return np.arange(size).astype(f"S{width}").view(np.uint8).reshape(size, width)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.cumsum([0] + [len(x) for x in lists])
    return np.fromiter((i for ids in lists for i in ids), np.int64, starts[-1]), starts


@dataclass
class Part:
    """A part's ids, the number of ids of each group, the groups as text, and its links (pairs of ids as numbers)."""

    n_a: int
    n_b: int
    n_groups: int
    groups: bytes
    links: bytes


class Aligner:
    """The two tokenizers, opened once in each worker, and what is known of parts.

    A pair of ids is the number ``a * size_b + b``.
    """

    def __init__(self, tokenizer_file: str, model_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        from tidewatch.llm.pieces import Codec

        self.a = Tokenizer.from_file(tokenizer_file)
        self.a.encode_special_tokens = True
        self.b = Codec(model_file)
        self.a_parts = ByteLevel(self.a)
        self.a_bytes, self.b_bytes = self.a_parts.tokens, _piece_bytes(self.b)
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.a_digits, self.b_digits = _digits(len(self.a_bytes)), _digits(len(self.b_bytes))
        self.size_b = len(self.b_bytes)
        self.kind = pair_kind(len(self.a_bytes), self.size_b)
        # A piece may not cross the places where parts are cut.
        whole = self.b.whole
        self.in_parts = self.b.by_word and not self.b.map.units and not self.b.squeeze and self.b.prefix
        self.in_parts = self.in_parts and not any("\n" in whole.id_to_piece(i) for i in range(self.size_b))
        self.known = Known(self._learn)

    def _pieces(self, texts: list[str]) -> list[list[int]]:
        if self.in_parts:
            return self.b.merges.encode([t.replace(" ", "▁") for t in texts], num_threads=1)
        return self.b.whole.encode([t[1:] for t in texts], num_threads=1)

    def ids(self, parts: list[bytes]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both tokenizers for parts."""
        flat, ends = self.a_parts.encode(parts)
        ids, cuts = flat.tolist(), [0, *ends.tolist()]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])], self._pieces([p.decode() for p in parts])

    def _learn(self, parts: list[bytes]) -> list[Part | None]:
        all_a, all_b = self.ids(parts)
        ok = [
            b"".join(map(self.a_bytes.__getitem__, a)) == p == b"".join(map(self.b_bytes.__getitem__, b))
            for p, a, b in zip(parts, all_a, all_b, strict=True)
        ]
        made = iter(self._aligned([a for a, k in zip(all_a, ok) if k], [b for b, k in zip(all_b, ok) if k]))
        return [next(made) if k else None for k in ok]

    def _aligned(self, lists_a: list[list[int]], lists_b: list[list[int]]) -> list[Part]:
        if not lists_a:
            return []
        a, a_starts = _flat(lists_a)
        b, b_starts = _flat(lists_b)
        ends_a, ends_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        common_a, common_b = common_ends(ends_a, ends_b, a_starts, b_starts)
        # Number of the group of each token, and how many tokens the groups before each group have.
        group_a, group_b = np.cumsum(common_a) - common_a, np.cumsum(common_b) - common_b
        before_a = np.append(0, np.flatnonzero(common_a) + 1)
        before_b = np.append(0, np.flatnonzero(common_b) + 1)
        of_a, of_b = overlaps(ends_a, ends_b)
        links = (a[of_a] * self.size_b + b[of_b]).astype(self.kind)
        links_at = np.searchsorted(of_b, b_starts)
        # Text of the groups: the tokens of both in order of groups, each with the sign that follows it.
        place_a = np.arange(len(a)) + before_b[group_a]
        place_b = np.arange(len(b)) + before_a[group_b + 1]
        width = max(self.a_digits.shape[1], self.b_digits.shape[1])
        signs = np.zeros((len(a) + len(b), width + 1), np.uint8)
        signs[place_a, : self.a_digits.shape[1]] = self.a_digits[a]
        signs[place_b, : self.b_digits.shape[1]] = self.b_digits[b]
        signs[place_a, width] = np.where(common_a, ord("|"), ord(","))
        signs[place_b, width] = np.where(common_b, ord(";"), ord(","))
        ends = np.append(0, np.cumsum((signs != 0).sum(1)))[a_starts + b_starts].tolist()
        text = signs[signs != 0].tobytes()
        n_groups = np.diff(np.append(0, np.cumsum(common_a))[a_starts]).tolist()
        blob, size = links.tobytes(), links.itemsize
        cuts = (links_at * size).tolist()
        return [
            Part(len(x), len(y), g, text[s : e - 1], blob[p:q])
            for x, y, g, s, e, p, q in zip(lists_a, lists_b, n_groups, ends[:-1], ends[1:], cuts[:-1], cuts[1:], strict=True)
        ]

    def align(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, bytes, bytes] | None]:
        """For each text n_a, n_b, n_groups, the groups as text, and the links; None for texts without tokens."""
        spaced = [b" " + t if t else b"" for t in texts]
        if self.in_parts:
            found = cut(spaced)
        else:
            found = Cut([t for t in spaced if t], np.arange(sum(map(bool, spaced))), np.cumsum([0] + [bool(t) for t in spaced]))
        parts = self.known.of(found.parts)
        numbers = np.array([(p.n_a, p.n_b, p.n_groups) if p else (0, 0, 0) for p in parts], np.int64).reshape(-1, 3)
        sums = np.vstack([np.zeros((1, 3), np.int64), np.cumsum(numbers[found.index], axis=0)])
        groups, links = [p and p.groups for p in parts], [p and p.links for p in parts]
        index = found.index.tolist()
        for i, (first, last) in enumerate(zip(found.starts[:-1].tolist(), found.starts[1:].tolist(), strict=True)):
            own = index[first:last]
            texts_of = [groups[k] for k in own]
            if not texts[i] or None in texts_of:
                yield None
                continue
            n = (sums[last] - sums[first]).tolist()
            yield *n, b";".join(texts_of), b"".join([links[k] for k in own])


def pair_kind(size_a: int, size_b: int) -> np.dtype:
    return np.dtype("<u4") if size_a * size_b <= 1 << 32 else np.dtype("<u8")


def _piece_bytes(codec) -> list[bytes]:
    whole = codec.whole
    return [
        bytes([int(whole.id_to_piece(i)[3:5], 16)]) if whole.is_byte(i) else whole.id_to_piece(i).replace("▁", " ").encode()
        for i in range(whole.get_piece_size())
    ]


_open: dict[tuple[str, str], Aligner] = {}


def aligner(tokenizer_file: str, model_file: str) -> Aligner:
    if (tokenizer_file, model_file) not in _open:
        _open[tokenizer_file, model_file] = Aligner(tokenizer_file, model_file)
    return _open[tokenizer_file, model_file]


ALIGNED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups {}, links binary"


def align_documents(docs: DataFrame, tokenizer_file: str, model_file: str, digest: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3``; with ``digest`` its SHA-256), and
    links (packed pair numbers, a for each overlapping pair of tokens) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = aligner(tokenizer_file, model_file)
        width = use.kind.itemsize
        for batch, texts in chunks(batches, _CHUNK):
            rows = []
            for got in use.align(texts):
                n_a, n_b, n_groups, groups, links = got or (0, 0, 0, b"", b"")
                text = groups.decode() if not digest else hashlib.sha256(groups).hexdigest() if groups else ""
                rows.append((n_a, n_b, n_groups, len(links) // width, text, links))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, ALIGNED.format("string"))


def pair_counts(aligned: DataFrame, size_a: int, size_b: int) -> DataFrame:
    """a, b, links, best (whether no other pair of this b has more) of every pair of ids that is linked somewhere."""
    kind = pair_kind(size_a, size_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Tally()
        for batch in batches:
            held.add(np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in column(batch, "links")] or [np.zeros(0, kind)]))
            yield from held.full()
        yield from held.rest()

    counts = aligned.where("n_links > 0").select("links").mapInArrow(run, Tally.SCHEMA).groupBy("key").agg(F.sum("times").alias("links"))
    counts = settle(
        counts.select(F.expr(f"key div {size_b}").cast("int").alias("a"), (F.col("key") % size_b).cast("int").alias("b"), "links"), "pair-counts"
    )
    # At most a row for each entry of the vocabulary.
    most = counts.groupBy("b").agg(F.max("links").alias("most"))
    return counts.join(F.broadcast(most), "b").select("a", "b", "links", (F.col("links") == F.col("most")).alias("best"))


def _scrambled(pair):
    """A 32-bit hash of pair numbers, as an array or a column; no step passes 63 bits."""
    return pair % (1 << 31) * 2654435769 % (1 << 32)


def write_pairs(pairs: DataFrame, folder: str, size_a: int, size_b: int) -> list[str | None]:
    """Files of the counts by shard of pair numbers; (ids of a) x (ids of b) / SHARD_PAIRS paths at most."""
    numbered = pairs.select((F.col("a").cast("bigint") * size_b + F.col("b")).alias("pair"), "links", "best")
    shards = 1 + size_a * size_b // SHARD_PAIRS
    rows = numbered.withColumn("shard", F.shiftright(_scrambled(F.col("pair")) * shards, 32).cast("int"))

    def make(own: pa.Table) -> dict[str, np.ndarray]:
        order = np.argsort(own["pair"].to_numpy())
        names = {"pairs": "pair", "links": "links", "best": "best"}
        return {k: own[n].to_numpy()[order] for k, n in names.items()} | {"best": own["best"].to_numpy()[order].astype(np.uint8)}

    found = write_shards(rows, folder, "pair-shards", make)
    return [found[i][0] if i in found else None for i in range(shards)]


def score_links(aligned: DataFrame, paths: list[str | None], size_a: int, size_b: int) -> DataFrame:
    """The aligned rows without their links, with n_best and count_sum by the counts of ``write_pairs``."""
    kind = pair_kind(size_a, size_b)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]

    def sums(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        blobs = [np.frombuffer(x.as_buffer(), kind) for x in column(batch, "links")]
        bounds = np.cumsum([0] + [len(x) for x in blobs])
        pairs, place = np.unique(np.concatenate(blobs), return_inverse=True)
        links, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        numbers = pairs.astype(np.int64)
        for s, own in each_shard(_scrambled(numbers) * len(paths) >> 32):
            shard = mapped(paths[s])
            at = np.searchsorted(shard["pairs"], numbers[own])
            links[own], best[own] = shard["links"][at], shard["best"][at]
        total = [np.append(0, np.cumsum(x[place])) for x in (links, best)]
        return tuple(t[bounds[1:]] - t[bounds[:-1]] for t in total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                count_sum, n_best = sums(batch)
                yield pa.RecordBatch.from_arrays(
                    [*(column(batch, n) for n in names), pa.array(n_best), pa.array(count_sum)], names=[*names, "n_best", "count_sum"]
                )

    schema = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, n_best bigint, count_sum bigint"
    return aligned.select(*names, "links").mapInArrow(run, schema)


def alignment_report(docs: DataFrame, tokenizer_file: str, model_file: str, folder: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.

    The alignment is settled once; counting and scoring read its links.
    """
    sizes = vocabulary_sizes(tokenizer_file, model_file)
    aligned = settle(align_documents(docs, tokenizer_file, model_file, digest=True), "aligned")
    paths = write_pairs(pair_counts(aligned, *sizes), folder, *sizes)
    return score_links(aligned, paths, *sizes).withColumnRenamed("groups", "groups_sha256")


def vocabulary_sizes(tokenizer_file: str, model_file: str) -> tuple[int, int]:
    import sentencepiece
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file).get_vocab_size(), sentencepiece.SentencePieceProcessor(model_file=model_file).get_piece_size()
