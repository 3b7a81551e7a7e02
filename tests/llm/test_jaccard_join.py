"""The n-gram Jaccard join against all pairs in plain Python."""

from __future__ import annotations

import random
import re

import pytest

from tidewatch.llm import jaccard_join
from tidewatch.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows):
    sets = {}
    for doc, text in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[doc] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    where = {}
    for d, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(d)
    seen = set()
    for ds in where.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                        x, y = sorted((find(a), find(b)))
                        root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def words(rng, n, vocabulary=4000):
    return [f"W{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_copies(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 5000)
    rng = random.Random(seed)
    texts = []
    for _ in range(12):  # chains of ever more changed copies
        w = words(rng, rng.choice([3, 6, 12, 40, 150]))
        for _ in range(8):
            texts.append(" ".join(w))
            w = list(w)
            for _ in range(rng.choice([0, 1, 1, 2])):
                w[rng.randrange(len(w))] = f"n{rng.random()}"
    shared = words(rng, 60)  # a passage that many texts have
    for _ in range(60):
        texts.append(" ".join(words(rng, rng.choice([5, 20, 60])) + shared + words(rng, 5)))
    hot = words(rng, 90)  # one large group of near copies
    for _ in range(80):
        w = list(hot)
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            w[rng.randrange(90)] = f"h{rng.random()}"
        texts.append(" ".join(w))
    texts += [None, "", "  ", "one two", "one  TWO", texts[5], texts[5]]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id bigint, text string, root string, class int").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(docs).collect()}
    assert got == plain(rows)
    kept = jaccard_join.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, (_, c) in got.items() if c == d)


def test_odd_rows(odd_docs, sf_docs):
    rows = jaccard_join.join(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    ids = {r["doc_id"]: r["component_id"] for r in rows}
    assert ids[None] is None and ids[0] == 0 and ids[1] == 1 and ids[10] == 9
    kept = [r["doc_id"] for r in jaccard_join.one_of_each_group(odd_docs).collect()]
    assert len(kept) == len(set(kept)) and None in kept and 10 not in kept
    assert jaccard_join.join(odd_docs.limit(0)).count() == 0
    some = sf_docs
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(some).collect()}
    assert got == plain([(r["doc_id"], r["text"]) for r in some.collect()])


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901), (950, 950)], "a bigint, b bigint")
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    assert roots == {i: 0 for i in range(201)} | {900: 900, 901: 900}


def test_columns_with_the_operators_own_names(spark):
    rows = [(1, "a b c d e f g", 1, 2, "x"), (2, "a b c d e f g", 3, 4, "y"), (3, "other words here", 5, 6, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _stays int, STAYS int, component_id string")
    kept = jaccard_join.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[2]]
