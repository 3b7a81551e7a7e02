"""Suffix-array dedup against a count of all windows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from tidewatch.llm import suffix_dedup


def plain(texts, window=suffix_dedup.WINDOW):
    count = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if count[t[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        kept = bytes(c for c, g in zip(t, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def planted(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["le", "über", "ha", "tion", "x", "straße"]) + str(rng.randrange(300))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line = prose(120), prose(58)
    texts = [prose(rng.choice([5, 60, 300])) for _ in range(20)]
    texts += [prose(rng.randrange(40)) + " " + passage + " " + prose(rng.randrange(60)) for _ in range(40)]
    texts += [line + prose(30) + line for _ in range(3)]
    base = prose(200).split()
    for _ in range(30):
        w = list(base)
        w[rng.randrange(200)] = word()
        texts.append(" ".join(w))
    texts += ["a" * 399, "b" * 400, "c" * 401, "d" * 3000, "ab" * 700, prose(20) * 9, "e" * 500 + prose(90) + "e" * 420, texts[3], texts[3], texts[2]]
    texts += [prose(70) + passage[:399], prose(70) + passage[7:408], "\0" * 900]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("data", [b"", b"a", b"banana", b"mississippi" * 3, b"aaaaaaaaab", b"baaaaaaaaa", bytes(range(256)) * 2])
def test_suffix_array(data):
    want = sorted(range(len(data)), key=lambda i: data[i:])
    assert suffix_dedup.suffix_array(data, depth=1000).tolist() == want


def test_suffix_array_of_random_bytes():
    rng = random.Random(5)
    for letters in (1, 2, 5, 256):
        data = bytes(rng.randrange(letters) for _ in range(700))
        assert suffix_dedup.suffix_array(data, depth=1000).tolist() == sorted(range(len(data)), key=lambda i: data[i:])


@pytest.mark.parametrize(("seed", "wide", "run"), [(1, 400, 1024), (2, 5, 1024), (3, 400, 90)])
def test_planted_repeats(spark, seed, wide, run, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "WIDE", wide)
    monkeypatch.setattr(suffix_dedup, "LONGEST_RUN", run)
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 20_000)
    texts = planted(seed)
    docs = spark.createDataFrame([(i, t, "s", 7) for i, t in enumerate(texts)] + [(500, None, "s", 0), (501, "", "s", 0)], "doc_id bigint, text string, spans string, n_chars int").repartition(4)
    want = dict(enumerate(plain([t.encode() for t in texts]))) | {500: plain([b""])[0], 501: plain([b""])[0]}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.digests(docs).collect()}
    assert got == want
    cut = suffix_dedup.without_repeats(docs)
    assert cut.columns == docs.columns
    rows = {r["doc_id"]: r for r in cut.collect()}
    assert len(rows) == len(want) and rows[500]["text"] is None and rows[500]["n_chars"] is None
    assert all(r["n_chars"] == len(r["text"]) for d, r in rows.items() if d != 500)
    assert all((rows[d]["text"] == texts[d]) == (want[d][1] == 0) for d in range(len(texts)))


def test_rows_that_share_an_id(spark, odd_docs):
    long = " ".join(str(i) for i in range(300))
    docs = spark.createDataFrame([(1, long), (1, long[:500]), (1, long[:300]), (None, long[50:]), (None, None), (2, "q"), (2, "q")], "doc_id bigint, text string")
    got = sorted((r["n_bytes"], r["n_removed"]) for r in suffix_dedup.digests(docs).collect())
    want = sorted(x[:2] for x in plain([(r["text"] or "").encode() for r in docs.collect()]))
    assert got == want
    assert suffix_dedup.digests(odd_docs).count() == odd_docs.count()
    assert suffix_dedup.digests(odd_docs.limit(0)).count() == 0
    assert suffix_dedup.without_repeats(odd_docs.limit(0)).columns == odd_docs.columns


def spans_of(text, repeated, window):
    gone = bytearray(len(text))
    for i in range(len(text) - window + 1):
        if text[i : i + window] in repeated:
            gone[i : i + window] = b"\1" * window
    return gone


@pytest.mark.parametrize(("seed", "wide", "window", "words"), [(4, 400, 150, 51), (5, 5, 150, 51), (6, 400, 40, 0), (7, 400, 9, 3)])
def test_shorter_windows_and_least_words(spark, monkeypatch, seed, wide, window, words):
    monkeypatch.setattr(suffix_dedup, "WIDE", wide)
    rng = random.Random(seed)
    word = lambda: rng.choice(["le", "u", "ha", "tion", "x", "stra"]) + str(rng.randrange(400))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(n) for n in (20, 30, 45, 51, 52, 60, 80)]
    texts = [" ".join(prose(rng.randrange(1, 40)) + " " + rng.choice(passages) for _ in range(rng.randrange(0, 3))) + " " + prose(50) for _ in range(60)]
    texts += ["to " * 300, "to " * 300, prose(9), ""]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id bigint, text string, OF_DOC int, of_text int").repartition(3)
    count = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    repeated = {w for w, n in count.items() if n > 1}
    got = suffix_dedup.without_repeats(docs, window, words)
    assert got.columns == docs.columns
    rows = {r["doc_id"]: r["text"] for r in got.collect()}
    for i, t in enumerate(texts):
        gone, want, at = spans_of(t, repeated, window), "", 0
        while at < len(t):
            end = at
            while end < len(t) and gone[end] == gone[at]:
                end += 1
            if not gone[at] or len(t[at:end].split()) < words:
                want += t[at:end]
            at = end
        assert rows[i] == want, i


def test_passages_of_over_50_words_go_and_shorter_ones_stay(spark):
    """Of 155 to 400 bytes, as the pipeline's stage cuts them."""
    import corpus_pipeline

    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    prose = lambda n, size=7: " ".join(word(size) for _ in range(n))
    long, short = [prose(52, size) for size in (2, 3, 4, 6)], [prose(40, 8), prose(30, 7), prose(48, 2)]
    rows, passages = [], []
    for i in range(40):
        own = rng.choice(long + short)
        passages.append(own)
        rows.append((i, prose(60) + " " + own + " " + prose(40), "en", "s", 0))
    rows += [(100 + i, prose(120), "en", "s", 0) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    assert {len(p) for p in long} == {155, 207, 259, 363}
    for (i, text, *_), own in zip(rows, passages):
        if own in long:
            assert own not in got[i] and len(got[i].split()) < len(text.split()) - 48
        else:
            assert got[i] == text
    assert all(got[i] == text for i, text, *_ in rows[40:])
