"""Phrase collocations against plain Python, and the double array against a dictionary."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import TEXTS
from tidewatch.llm import collocations, double_array
from tidewatch.session import scratch_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, best, longest=3):
    """(lang, text) rows -> the wanted rows, phrase by phrase."""
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        chosen = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        inside = set()
        for p, c in chosen.items():
            for n in range(2, len(p)):
                inside |= {q for q in (p[i : i + n] for i in range(len(p) - n + 1)) if 100 * c >= 50 * chosen[q]}
        found = []
        for p, a in chosen.items():
            if p not in inside:
                cuts = [(1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def got(spark, rows, **params):
    docs = spark.createDataFrame(
        [(i, lang, text, 1, 2) for i, (lang, text) in enumerate(rows)], "doc_id bigint, lang string, text string, word int, times int"
    ).repartition(3)
    return sorted(tuple(r) for r in collocations.collocations(docs, scratch_path(spark, "p"), **params).collect())


def made_rows(seed, n):
    rng = random.Random(seed)
    words = [rng.choice("abcdeXÉ") * rng.randrange(1, 4) + rng.choice(["", "o", "日"]) for _ in range(25)]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  \t", ". ", ",", "\n", " "]) for _ in range(rng.randrange(0, 60)))
        rows.append((rng.choice(["en", "de", None, "", "langue inconnue"]), text))
    return rows


@pytest.mark.parametrize(("least", "best", "longest"), [(10, 2000, 3), (2, 40, 4), (1, 25, 2)])
def test_equals_plain_python(spark, least, best, longest):
    rows = made_rows(longest, 120) + [("en", t) for t in TEXTS] + [("en", None), ("en", ""), (None, "same same same same")] * 3
    want = plain(rows, least, best, longest)
    assert want
    assert got(spark, rows, least=least, best=best, max_words=longest, shard_phrases=50) == want


def test_little_tables(spark):
    assert got(spark, []) == []
    assert got(spark, [("en", "too few words"), (None, None)]) == []
    assert got(spark, [("en", "a b " * 9)] * 2) == plain([("en", "a b " * 9)] * 2, 10, 2000)


def test_words_with_the_same_first_hash_stay_apart(spark):
    words = spark.createDataFrame([("en", f"w{i}", 10 + i) for i in range(300)] + [("de", "w1", 5)], "lang string, word string, times bigint")
    vocabulary = collocations.write_vocabulary(words, scratch_path(spark, "v"))
    import pyarrow as pa

    arr = pa.array([f"w{i}".encode() for i in range(301)], pa.binary())
    numbers = vocabulary.numbers(*collocations.hashes(arr, "en"))
    assert len(set(numbers.tolist())) == 301 and numbers[300] == 0
    texts, languages = vocabulary.texts(numbers[:300])
    assert texts.tolist() == [f"w{i}".encode() for i in range(300)] and set(languages) == {b"en"}
    assert (vocabulary.times(numbers[:300]) == np.arange(10, 310)).all()
    assert vocabulary.texts(vocabulary.numbers(*collocations.hashes(arr[1:2], "de")))[1][0] == b"de"


@pytest.mark.parametrize("seed", range(4))
def test_double_array_equals_a_dictionary(seed):
    rng = np.random.default_rng(seed)
    states = np.minimum(rng.geometric(0.01, 4000), 900) * 7
    words = rng.integers(1, 3000, 4000)
    keys = np.unique(states << 32 | words)
    level = double_array.build(keys >> 32, keys & 0xFFFFFFFF)
    want = {int(k): i for i, k in enumerate(keys)}
    ask = np.concatenate([keys, rng.integers(0, 6400, 5000) << 32 | rng.integers(0, 3100, 5000)])
    found = double_array.step(level, ask >> 32, ask & 0xFFFFFFFF)
    assert found.tolist() == [want.get(int(k), -1) for k in ask]
    assert len(level["check"]) < 3 * len(keys) + 3000
