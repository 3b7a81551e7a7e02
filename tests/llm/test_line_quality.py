"""The line-quality field: forward-backward by enumeration, its gradient by differences, measures by hand, held-out accuracy."""

from __future__ import annotations

import itertools
import os
import random

import numpy as np
import pytest

from tests.llm.conftest import SF, TEXTS
from tidewatch.llm import line_quality as q
from tidewatch.llm import queries


def enumerated(good, pairs):
    """Probability of good lines, expected pairs, log partition of one text, over all labellings."""
    n, total, mean, both = len(good), 0.0, np.zeros(len(good)), np.zeros((2, 2))
    for labels in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(g for g, y in zip(good, labels) if y) + sum(pairs[a, b] for a, b in zip(labels, labels[1:])))
        total += w
        mean += w * np.array(labels)
        for a, b in zip(labels, labels[1:]):
            both[a, b] += w
    return mean / total, both / total, np.log(total)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    sizes = [1, 5, 3, 1, 7, 2]
    bounds, pairs = np.cumsum([0, *sizes]), rng.normal(size=(2, 2))
    good = rng.normal(size=bounds[-1]) * 2
    probability, expected, log_total = q.forward_backward(good, pairs, bounds)
    want = [enumerated(good[a:b], pairs) for a, b in zip(bounds, bounds[1:])]
    assert np.allclose(probability, np.concatenate([w[0] for w in want]))
    assert np.allclose(expected, sum(w[1] for w in want))
    assert np.isclose(log_total, sum(w[2] for w in want))


def test_expectations_are_the_gradient_of_the_log_partition():
    rng = np.random.default_rng(2)
    bounds, good, pairs = np.array([0, 4, 5, 9]), rng.normal(size=9), rng.normal(size=(2, 2))
    probability, expected, _ = q.forward_backward(good, pairs, bounds)
    h = 1e-5
    for i in range(9):
        up, down = good.copy(), good.copy()
        up[i] += h
        down[i] -= h
        slope = (q.forward_backward(up, pairs, bounds)[2] - q.forward_backward(down, pairs, bounds)[2]) / (2 * h)
        assert np.isclose(slope, probability[i], atol=1e-6)
    for i, j in itertools.product((0, 1), repeat=2):
        up, down = pairs.copy(), pairs.copy()
        up[i, j] += h
        down[i, j] -= h
        slope = (q.forward_backward(good, up, bounds)[2] - q.forward_backward(good, down, bounds)[2]) / (2 * h)
        assert np.isclose(slope, expected[i, j], atol=1e-6)


def test_extreme_weights_stay_finite():
    probability, expected, total = q.forward_backward(np.array([800.0, -900, 700]), np.array([[500.0, -600], [-600, 500]]), np.array([0, 3]))
    assert np.isfinite(probability).all() and np.isfinite(expected).all() and np.isfinite(total)


def test_measures_of_lines():
    texts = [b"Hello world!! 12\n\nHello world!! 12\nto to | to #x", b"", b"\n", b"Hello world!! 12", "Été ß".encode()]
    rows, size, bounds = q.measures(texts)
    assert bounds.tolist() == [0, 4, 5, 7, 8, 9]
    assert size.tolist() == [16, 0, 16, 13, 0, 0, 0, 16, 8]
    of = {name: rows[:, i] for i, name in enumerate(q.MEASURES)}
    assert of["repeated_line"].tolist() == [1, 0, 1, 0, 0, 0, 0, 0, 0]
    assert of["repeated_grams"].tolist() == [1, 0, 1, 0, 0, 0, 0, 0, 0]
    assert of["empty"].tolist() == [0, 1, 0, 0, 1, 1, 1, 0, 0]
    assert np.allclose(of["same_as_before"], [0, 0, 0, 1 / 5, 0, 0, 0, 0, 0])
    assert np.allclose(of["repeated_in_line"], [0, 0, 0, 3 / 5, 0, 0, 0, 0, 0])
    assert np.allclose(of["digits"], [2 / 16, 0, 2 / 16, 0, 0, 0, 0, 2 / 16, 0])
    assert np.allclose(of["calls"][0], 2 / 16) and np.allclose(of["signs"][3], 2 / 13)
    assert np.allclose(of["high"], [0] * 8 + [6 / 8])
    assert of["begins_capital"].tolist() == [1, 0, 1, 0, 0, 0, 0, 1, 1]
    beside = q.with_neighbours(rows, bounds)
    n = len(q.MEASURES)
    assert (beside[1, n : 2 * n] == rows[0]).all() and (beside[1, 2 * n : 3 * n] == rows[2]).all()
    assert not beside[4, n : 3 * n].any() and beside[:, -2].sum() == beside[:, -1].sum() == 5
    # One text at a time gives the same.
    alone = np.vstack([q.measures([t])[0] for t in texts])
    assert np.allclose(rows, alone)


def planted(spark, n=500):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.25
        lines = []
        for _ in range(rng.randrange(1, 9)):
            line = [rng.choice(words) for _ in range(rng.randrange(4, 15))]
            lines.append(" ".join(w + "##" for w in line) if bad and rng.random() < 0.8 else " ".join(line).capitalize() + ".")
        rows.append((i, "\n".join(lines), "x", int(bad)))
        labels.append((i, None if i % 11 == 0 else 1 - int(bad), 0))
    return spark.createDataFrame(rows, "doc_id bigint, text string, score string, bad int"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), rows


def test_learns_planted_lines(spark):
    docs, labels, rows = planted(spark)
    model = q.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in q.score(docs, model).collect()}
    sure = [(i, bad) for i, text, _, bad in rows if bad == ("##" in text)]
    right = sum((got[i] < 0.5) == bool(bad) for i, bad in sure)
    assert right >= 0.97 * len(sure)
    lines = q.label_lines(docs, model).collect()
    assert len(lines) == sum(t.count("\n") + 1 for _, t, *_ in rows)
    heavy, weight = {}, {}
    for r in lines:
        heavy[r["doc_id"]] = heavy.get(r["doc_id"], 0) + r["length"] * r["probability"]
        weight[r["doc_id"]] = weight.get(r["doc_id"], 0) + r["length"]
    assert all(abs(heavy[i] / weight[i] - got[i]) < 1e-9 for i in got)


def test_fit_does_not_depend_on_partitions_or_held_out_labels(spark):
    docs, labels, _ = planted(spark, 150)
    one = q.fit(docs, labels)
    other = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality", "toxic")
    two = q.fit(docs.repartition(5), other)
    assert np.array_equal(one.weights, two.weights) and np.array_equal(one.pairs, two.pairs)


def test_odd_texts(spark, odd_docs):
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(len(TEXTS))] + [(None, 1, 0), (4, None, 0), (5, 7, 0)], "doc_id bigint, quality int, toxic int")
    model = q.fit(odd_docs, labels)
    got = q.score(odd_docs, model).collect()
    assert len(got) == len(TEXTS) + 2 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in got if r["doc_id"] in (0, 1)} == {model.share}
    one = q.fit(odd_docs, labels.where("quality = 1"))
    assert {r["score"] for r in q.score(odd_docs, one).collect()} == {1.0}
    none = q.fit(odd_docs, labels.where("false"))
    assert {r["score"] for r in q.score(odd_docs, none).collect()} == {0.5}
    assert q.score(odd_docs.where("false"), model).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_held_out_accuracy(spark, sf):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op13_line_quality(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    good = [r for r in rows if labels[r["doc_id"]] == 1]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in rows) >= 0.95 * len(rows)
    assert sum(r["predicted"] for r in good) >= 0.97 * len(good)
