"""The language model against counts kept in plain dictionaries."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidewatch.llm import ngram_lm
from tidewatch.session import scratch_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(low), None]


@pytest.mark.parametrize("source", ["odd", "sf"])
def test_scores(spark, odd_docs, sf_docs, source, monkeypatch):
    monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", 3000)
    monkeypatch.setattr(ngram_lm, "_HELD", 500)
    docs = odd_docs if source == "odd" else sf_docs
    out = ngram_lm.held_out(docs["doc_id"])
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    train = [t for d, t in rows if d is not None and zlib.crc32(str(d).encode()) % 5 != 1]
    words = Counter(w for t in train for w in tokens(t))
    pairs = Counter(p for t in train for p in zip([None, *tokens(t)], tokens(t)))
    after = Counter()
    for (a, _), n in pairs.items():
        after[a] += n
    total, size = sum(words.values()), len(words)
    model = ngram_lm.train(docs.where(~out), scratch_path(spark, "test-lm"))
    assert (model.tokens, model.size) == (total, size) and (source == "odd" or model.shards > 3)

    def single(w):
        return (words[w] + 0.5) / (total + 0.5 * (size + 1))

    def pair(a, w):
        if a is not None and a not in words:
            return single(w)
        return (pairs[a, w] + model.strength * single(w)) / (after[a] + model.strength)

    got = ngram_lm.score(docs, model).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        t = tokens(texts[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(w in words for w in t), total)
        assert math.isclose(r["base_score"], sum(math.log10(single(w)) for w in t), rel_tol=1e-9)
        want = sum(math.log10(pair(a, w)) for a, w in zip([None, *t], t))
        assert abs(r["score"] - want) <= len(t) * ngram_lm._STEP


def test_strength_has_the_best_leave_one_out_likelihood(spark):
    # The same texts again and again: pairs tell much, so the prior is weak.
    docs = spark.createDataFrame([(i, " ".join(f"w{i % 7}x{j}" for j in range(30))) for i in range(70)], "doc_id bigint, text string")
    assert ngram_lm.train(docs, scratch_path(spark, "test-lm")).strength == min(ngram_lm.STRENGTHS)


def test_no_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id bigint, text string")
    model = ngram_lm.train(docs.limit(0), scratch_path(spark, "test-lm"))
    rows = {r["doc_id"]: r for r in ngram_lm.score(docs, model).collect()}
    assert rows[1]["n_tokens"] == 3 and rows[1]["n_known"] == 0 and rows[1]["base_score"] == 0.0 and rows[None]["n_tokens"] == 1


def test_quantised_values():
    x = -np.linspace(0, ngram_lm.LOWEST, 1000)
    assert np.abs(ngram_lm.restored(ngram_lm.quantised(x)) - x).max() <= ngram_lm._STEP / 2 + 1e-12
