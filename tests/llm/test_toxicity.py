"""The toxicity classifier: features by brute force, learning on planted words, held-out accuracy."""

from __future__ import annotations

import os
import random

import pytest

import corpus_pipeline
from tests.llm.conftest import SF
from tidewatch.llm import queries, toxicity


def test_features_are_distinct_folded_grams():
    a, starts = toxicity.features([b"Ab  cd", b" ab\ncd", b"", b"  ", b"abab abab"])
    parts = [set(a[x:y].tolist()) for x, y in zip(starts, starts[1:])]
    assert parts[0] == parts[1] and not parts[2] and not parts[3]
    assert starts[-1] == sum(map(len, parts))
    text = " abab abab "
    grams = {text[i : i + n] for n in toxicity.ORDERS for i in range(len(text) - n + 1)}
    assert len(parts[4]) == len(grams)


def planted(spark, n=900):
    rng = random.Random(3)
    words = [f"{a}{b}{c}" for a in "kmrt" for b in ("an", "el", "or", "ist") for c in ("a", "en", "ut", "")]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(20, 200))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["wretched", "vermin", "halfwit"])
        rows.append((i, " ".join(w), toxic))
        labels.append((i, 1, toxic if i % 7 else None))
    return spark.createDataFrame(rows, "doc_id bigint, text string, score int"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), rows


def test_learns_planted_words_and_keeps_clean_documents(spark):
    docs, labels, rows = planted(spark)
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    right = [(got[i] >= 0.5) == bool(t) for i, _, t in rows]
    assert sum(right) >= 0.98 * len(rows)
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, s in got.items() if s < 0.5}


def test_bounded_sample_keeps_the_share_of_all_labels(spark):
    """A word that most toxic texts have but more clean ones: likely toxic only if the sample's share is believed."""
    rng = random.Random(5)
    rows = []
    for i in range(2000):
        toxic = int(i % 10 == 0)
        w = [rng.choice(["salt", "tree", "river", "green", "paper", "seven"]) for _ in range(12)]
        if rng.random() < (0.8 if toxic else 0.2):
            w.insert(rng.randrange(12), "doubtful")
        rows.append((i, " ".join(w), toxic))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    labels, bounds = docs.select("doc_id", "toxic"), {1: 120, 0: 120}
    scores = [r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels, bounds)).collect()]
    assert abs(sum(scores) / len(scores) - 0.1) < 0.05
    assert sum(s >= 0.5 for s in scores) < 0.1 * len(rows)
    assert toxicity.prior_shift(labels) == 0


def test_held_out_labels_are_never_learnt_from(spark):
    docs, labels, _ = planted(spark, 60)
    ids = {r["doc_id"] for r in toxicity.sample_rows(docs, labels).collect()}
    held = {r["doc_id"] for r in docs.where(toxicity.fold(docs["doc_id"]) == 0).collect()}
    assert ids and not ids & held


def test_one_class_or_none(spark, odd_docs):
    docs, labels, _ = planted(spark, 20)
    for some in (labels.where("toxic = 0"), labels.limit(0)):
        scores = [r["score"] for r in toxicity.score(docs, toxicity.fit(docs, some)).collect()]
        assert max(scores) < 0.5
    model = toxicity.fit(docs, labels)
    assert toxicity.score(odd_docs, model).count() == odd_docs.count()
    assert toxicity.score(odd_docs.limit(0), model).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_query_covers_all_documents(spark):
    rows = queries.op8_toxicity(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_least_texts_follow_the_smaller_class():
    got = {n: toxicity.least_texts(n, 3000) for n in (1, 2, 3, 10, 44, 200, 357, 1000)}
    assert got == {1: 1, 2: 2, 3: 3, 10: 3, 44: 4, 200: 14, 357: 25, 1000: 25}
    assert toxicity.least_texts(3000, 44) == 4


@pytest.mark.parametrize("sf, caught, wrong", [("sf0.001", 10, 1), ("sf0.01", 46, 3)])
def test_small_tables_catch_their_toxic_rows(spark, sf, caught, wrong):
    """Few labelled rows are enough to learn from, in the query and in the pipeline's stage."""
    sf_dir = f"{os.path.dirname(SF)}/{sf}"
    if not os.path.isdir(sf_dir):
        pytest.skip("test tables are not here")
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r["doc_id"]: r["toxic"] for r in labels.where("toxic IN (0, 1)").collect()}
    named = {r["doc_id"] for r in queries.op8_toxicity(spark, sf_dir).where("predicted = 1").collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, sf_dir).select("doc_id").collect()}
    for gone in (named, toxic.keys() - kept):
        hits = [sum(toxic[d] == t for d in gone if d in toxic) for t in (1, 0)]
        assert hits[0] >= caught and hits[1] <= wrong
