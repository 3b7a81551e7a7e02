"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

A document's set is its distinct 5-word shingles (64-bit hashes). Documents link if the
Jaccard similarity is 0.75 or more; the groups are the connected components.

1. Equal sets become one class (a digest of the set, grouped); only the document with the
   smallest id of a class goes on.
2. The incidence is cut into blocks of n-gram columns. A block holds, for each document, the
   n-grams that fall into it; its product with itself tells which n-grams two or more
   documents share, and how many (their frequency). Only shared n-grams come back, packed.
3. Size-derived bounds: a document links only if at least three quarters of its set are
   shared. Of documents that pass, the rarest ``shared - ceil(3/4 size) + 1`` shared n-grams
   must hold one that a linked document has among its own such n-grams, and sizes and the
   places of that n-gram bound the overlap from above. Pairs below the bounds are dropped.
4. The overlap of a remaining pair is counted exactly on the shared n-grams of both
   (n-grams that only one document has add nothing to an overlap).

Near copies by the thousand share their n-grams with each other. For them not all pairs
are looked at: first every document meets one leader, which leads most of its rare
n-grams' lists; documents that link with the same leader are connected already, so only
pairs that are not yet connected follow, each n-gram's list minus its largest connected
part against the whole list. No list is capped; no link between unconnected documents is lost.

Defined cases: texts without words (null, empty) have size 0 and link with nothing; fewer
than five words are one shingle; a null doc_id links with nothing and has a null component;
repeated rows are copies of each other (of rows that share a doc_id but differ in text one
takes part in links, the others link with nothing); further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import chunks, column, hashed_words, mix, settle
from tidewatch.llm.components import components

N = 5
# Shingles in one block of the product.
BLOCK_SHINGLES = 3_000_000
_CHUNK = 4_000_000
_FACTORS = mix(np.arange(11, 11 + N, dtype=np.uint64)) | np.uint64(1)
_HALF = np.uint64(32)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct shingles of each text, as sorted 64-bit hashes."""
    words, starts = hashed_words(texts)
    with np.errstate(over="ignore"):
        count = len(words) - N + 1
        grown = np.zeros(max(count, 0), np.uint64)
        for j in range(N):
            grown += words[j : j + len(grown)] * _FACTORS[j]
        grown = mix(grown)
        out = []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if b - a >= N:
                out.append(np.unique(grown[a : b - N + 1]))
            elif b > a:
                short = (words[a:b] * _FACTORS[: b - a]).sum() + np.uint64(b - a)
                out.append(mix(np.array([short], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _class_of(shingles: np.ndarray) -> int:
    """A digest of the set."""
    with np.errstate(over="ignore"):
        first, second = shingles.sum(dtype=np.uint64), mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
        return int(mix(np.array([first ^ mix(np.array([second + np.uint64(len(shingles))]))[0]]))[0].astype(np.int64))


def _classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, _CHUNK):
            sets = shingle_sets(texts)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_class_of(s) for s in sets], pa.int64())],
                names=["doc_id", "n_shingles", "class"],
            )

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, class bigint")


def _runs_of(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values begins, and its length."""
    heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
    return heads, np.diff(heads, append=len(owner))


def _blob(rows: pa.Table, name: str, kind) -> np.ndarray:
    parts = [np.frombuffer(x.as_buffer(), kind) for x in rows.column(name)]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _incidence(docs: DataFrame, blocks: int) -> DataFrame:
    """Rows of a block: documents, how many n-grams of each, and the n-grams' low halves, packed.

    ``docs`` has doc_id, text, class; a text that is not of the class is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, _CHUNK):
            wanted = zip(shingle_sets(texts), column(batch, "doc_id").to_pylist(), column(batch, "class").to_pylist(), strict=True)
            sets = [(s, doc) for s, doc, name in wanted if _class_of(s) == name]
            if not sets:
                continue
            names = np.array([doc for _, doc in sets], np.int64)
            owner = np.repeat(np.arange(len(sets)), [len(s) for s, _ in sets])
            grams = np.concatenate([s for s, _ in sets])
            block = ((grams >> _HALF) * np.uint64(blocks) >> _HALF).astype(np.int32)
            order = np.argsort(block, kind="stable")
            cuts = np.searchsorted(block[order], np.arange(blocks + 1))
            rows = []
            for b in range(blocks):
                part = order[cuts[b] : cuts[b + 1]]
                if len(part):
                    own = owner[part]
                    heads, sizes = _runs_of(own)
                    low = (grams[part] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                    rows.append((b, names[own[heads]].tobytes(), sizes.astype(np.uint32).tobytes(), low.tobytes()))
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["block", "docs", "sizes", "grams"]
            )

    return docs.mapInArrow(run, "block int, docs binary, sizes binary, grams binary")


_SHARED = "bucket int, block int, docs binary, sizes binary, grams binary, often binary"


def _block_product(buckets: int):
    def product(rows: pa.Table) -> pa.Table:
        """Shared n-grams of one block, packed by the bucket of the document: which, and how many documents have each."""
        block = rows.column("block")[0].as_py()
        grams = _blob(rows, "grams", np.uint32)
        owner = np.repeat(_blob(rows, "docs", np.int64), _blob(rows, "sizes", np.uint32))
        order = np.argsort(grams, kind="stable")
        grams, owner = grams[order], owner[order]
        same = grams[1:] == grams[:-1]
        shared = np.append(same, False) | np.insert(same, 0, False)
        grams, owner = grams[shared], owner[shared]
        # A document may come twice (repeated rows); it counts once.
        order = np.lexsort((owner, grams))
        grams, owner = grams[order], owner[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        grams, owner = grams[new], owner[new]
        counts = _runs_of(grams)[1]
        often = np.repeat(counts, counts)
        keep = often >= 2
        grams, owner, often = grams[keep], owner[keep], np.minimum(often[keep], 0xFFFF).astype(np.uint16)
        bucket = owner % buckets
        order = np.lexsort((grams, owner, bucket))
        grams, owner, often, bucket = grams[order], owner[order], often[order], bucket[order]
        out = []
        for a, n in zip(*_runs_of(bucket), strict=True):
            part = slice(a, a + n)
            heads, sizes = _runs_of(owner[part])
            out.append((bucket[a], block, owner[part][heads].tobytes(), sizes.astype(np.uint32).tobytes(), grams[part].tobytes(), often[part].tobytes()))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        cols = list(zip(*out, strict=True)) or [[]] * len(kinds)
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("bucket", "block", "docs", "sizes", "grams", "often"), cols, kinds, strict=True)})

    return product


def _gathered(shared: pa.Table, sizes: pa.Table) -> pa.Table:
    """Documents of a bucket with enough shared n-grams: doc, n, grams, often."""
    each = _blob(shared, "sizes", np.uint32)
    owner = np.repeat(_blob(shared, "docs", np.int64), each)
    lengths = [len(x.as_buffer()) // 4 for x in shared.column("grams")]
    block = np.repeat(np.array(shared.column("block").to_pylist(), np.int64), lengths)
    grams = (block << 32) | _blob(shared, "grams", np.uint32).astype(np.int64)
    often = _blob(shared, "often", np.uint16).astype(np.int32)
    order = np.argsort(owner, kind="stable")
    owner, grams, often = owner[order], grams[order], often[order]
    heads, counts = _runs_of(owner)
    docs, n = sizes.column("doc").to_numpy(), sizes.column("n").to_numpy()
    by = np.argsort(docs)
    n = n[by][np.searchsorted(docs[by], owner[heads])]
    enough = counts >= -(-3 * n // 4)
    keep = np.repeat(enough, counts)
    offsets = pa.array(np.append(0, np.cumsum(counts[enough])), pa.int32())
    return pa.table(
        {
            "doc": pa.array(owner[heads][enough]),
            "n": pa.array(n[enough]),
            "grams": pa.ListArray.from_arrays(offsets, pa.array(grams[keep])),
            "often": pa.ListArray.from_arrays(offsets, pa.array(often[keep])),
        }
    )


def _needed(n: Column) -> Column:
    """Least overlap of a set of size n with any set that it links with: ceil(3/4 n)."""
    return F.floor((3 * n + 3) / 4)


def _verified(pairs: DataFrame, shared: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by their exact overlap."""
    left = shared.select(F.col("doc").alias("a"), F.col("n").alias("n_a"), F.col("grams").alias("grams_a"))
    right = shared.select(F.col("doc").alias("b"), F.col("n").alias("n_b"), F.col("grams").alias("grams_b"))
    overlap = F.size(F.array_intersect("grams_a", "grams_b"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").withColumn("both", overlap)
    return joined.where("100 * both >= 75 * (n_a + n_b - both)").select("a", "b")


def _links(shared: DataFrame) -> DataFrame:
    """Links (a, b) between documents, enough of them to connect all that is connected."""
    items = F.sort_array(F.arrays_zip(F.col("often").alias("often"), F.col("grams").alias("gram")))
    prefix = F.slice("items", F.lit(1), (F.col("s") - _needed(F.col("n")) + 1).cast("int"))
    lists = settle(
        shared.select("doc", "n", F.size("grams").alias("s"), items.alias("items"))
        .select("doc", "n", "s", F.posexplode(prefix).alias("at", "item"))
        .select(F.col("item.gram").alias("gram"), "doc", "n", "s", "at"),
        "jaccard-lists",
    )
    # First every document meets the one that leads most of its lists. A list is led by the document with the
    # fewest n-grams of its own: among changed copies of one text that is the text itself, if it is there.
    leaders = lists.groupBy("gram").agg(F.min(F.struct((F.col("n") - F.col("s")).alias("own"), "doc")).alias("least"))
    leaders = leaders.select("gram", F.col("least.doc").alias("leader"))
    led = lists.join(leaders, "gram").where("doc <> leader").groupBy("doc", "leader").count()
    first = led.groupBy(F.col("doc").alias("a")).agg(F.max_by("leader", F.struct("count", "leader")).alias("b"))
    linked = settle(_verified(first, shared), "jaccard-first")
    # Then pairs that are not connected yet.
    known = components(linked)
    labelled = lists.join(known.withColumnRenamed("node", "doc"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    parts = labelled.groupBy("gram", "root").count()
    open_ = parts.groupBy("gram").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    rest = settle(labelled.join(open_.select("gram", "main"), "gram"), "jaccard-open")
    few = rest.where("root <> main").select(*(F.col(c).alias(f"{c}_x") for c in ("gram", "doc", "n", "s", "at", "root")))
    bound = F.floor((3 * (F.col("n") + F.col("n_x")) + 6) / 7)  # of the overlap: 3/7 of both sizes, rounded up
    pairs = (
        few.join(rest, few.gram_x == rest.gram)
        .where(F.col("root") != F.col("root_x"))
        .where((100 * F.least("n", "n_x") >= 75 * F.greatest("n", "n_x")) & (F.least(F.col("s") - F.col("at"), F.col("s_x") - F.col("at_x")) >= bound))
        .select(F.least("doc", "doc_x").alias("a"), F.greatest("doc", "doc_x").alias("b"))
        .distinct()
    )
    return linked.unionByName(_verified(pairs, shared))


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, one row for each document row."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = settle(_classes(rows), "jaccard-classes")
    of_doc = own.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("class", "n_shingles")).alias("set"))
    classes = of_doc.groupBy("set.class").agg(F.min("doc_id").alias("doc"), F.min("set.n_shingles").alias("n"))
    classes = settle(classes, "jaccard-sets")
    total = classes.agg(F.sum("n")).first()[0] or 0
    blocks = 1 + int(total) // BLOCK_SHINGLES
    one_each = rows.join(classes.select(F.col("doc").alias("doc_id"), "class"), "doc_id")
    product = _incidence(one_each, blocks).groupBy("block").applyInArrow(_block_product(blocks), _SHARED)
    sizes = classes.select("doc", "n", F.pmod("doc", F.lit(blocks)).cast("int").alias("bucket"))
    shared = product.groupBy("bucket").cogroup(sizes.groupBy("bucket")).applyInArrow(
        _gathered, "doc bigint, n bigint, grams array<bigint>, often array<int>"
    )
    shared = settle(shared, "jaccard-shared")
    groups = components(_links(shared)).select(F.col("node").alias("doc"), "root")
    named = classes.join(groups, "doc", "left").select("class", F.coalesce("root", "doc").alias("component_id"))
    joined = own.join(named, "class", "left").join(of_doc.select(F.col("doc_id").alias("of"), F.col("set.class").alias("main")), F.col("doc_id") == F.col("of"), "left")
    linked = (F.col("n_shingles") > 0) & (F.col("class") == F.col("main"))
    return joined.select("doc_id", "n_shingles", F.when(linked, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The documents without all but the smallest doc_id of each component, with all their columns.

    Of equal rows (doc_id and text) one stays; rows with a null doc_id all stay.
    """
    taken = {c.lower() for c in docs.columns}
    name = next(n for n in ("stays" + "_" * i for i in range(len(taken) + 1)) if n not in taken)
    stay = join(docs).where("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    kept = docs.join(stay, F.col("doc_id").cast("bigint") == F.col(name), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where("doc_id IS NULL"))
