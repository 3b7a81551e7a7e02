"""Cross-tokenizer alignment against plain Python over whole texts."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import TEXTS, by_id
from tidewatch.llm import queries, token_align
from tidewatch.session import scratch_path


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(queries.TOKENIZER)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)


def byte_alphabet():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {chr(b): b for b in shown}, 0
    for b in range(256):
        if b not in shown:
            out[chr(256 + extra)], extra = b, extra + 1
    return out


def plain(a, b, text):
    """Ids, groups and links of one text, token by token."""
    if not text:
        return None
    alphabet = byte_alphabet()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
    whole = (" " + text).encode()
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return None
    spans = []
    for tokens in (bytes_a, bytes_b):
        at, out = 0, []
        for t in tokens:
            out.append((at, at + len(t)))
            at += len(t)
        spans.append(out)
    links = [(x, y) for (s, e), x in zip(spans[0], ids_a) for (p, q), y in zip(spans[1], ids_b) if s < q and p < e] if len(ids_a) < 3000 else None
    common = {e for _, e in spans[0]} & {e for _, e in spans[1]}
    groups, at = [], 0
    for end in sorted(common):
        own_a = [str(i) for (s, e), i in zip(spans[0], ids_a) if at < e <= end]
        own_b = [str(i) for (s, e), i in zip(spans[1], ids_b) if at < e <= end]
        groups.append(",".join(own_a) + "|" + ",".join(own_b))
        at = end
    return ids_a, ids_b, groups, links


MORE = ["▁literal", "tab\tand no-break 　wide", "it's we'll\n\nTHEY'RE  x\n y", "<|endoftext|> in <s> text </s>", "a\nb\nc.d, e.\nf", "\n", " lead", "trail ", "日本語のテキスト。" * 40]


def test_alignment_equals_plain_python(spark, libraries):
    texts = [*(t for t in TEXTS if t is None or len(t) < 4000), *MORE]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(1, texts[1], "x", 1), (None, "no id here", "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, links string, n_a int").repartition(3)
    want = [plain(*libraries, t) for _, t, *_ in rows]
    counts = Counter(pair for w in want if w for pair in w[3])
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = by_id(token_align.alignment_report(docs, queries.TOKENIZER, queries.PIECE_MODEL, scratch_path(spark, "t")).collect(), *names)
    assert len(got) == len(texts) + 1
    for (doc, *_), w in zip(rows, want):
        if w is None:
            assert got[doc] == (0, 0, 0, 0, 0, 0, "")
            continue
        ids_a, ids_b, groups, links = w
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        best = sum(counts[p] == most[p[1]] for p in links)
        assert got[doc] == (len(ids_a), len(ids_b), len(groups), len(links), best, sum(counts[p] for p in links), digest), doc


def test_whole_table_equals_the_libraries(spark, libraries, sf_docs):
    got = {r["doc_id"]: r for r in token_align.align_documents(sf_docs, queries.TOKENIZER, queries.PIECE_MODEL).collect()}
    docs = sf_docs.collect()
    assert len(got) == len(docs)
    for d in docs[:120]:
        w = plain(*libraries, d["text"]) if len(d["text"]) < 6000 else None
        if w:
            r = got[d["doc_id"]]
            assert r["groups"] == ";".join(w[2])
            assert r["n_links"] == len(w[3]) == r["n_a"] + r["n_b"] - r["n_groups"]
            pairs = np.frombuffer(r["links"], "<u4").tolist()
            assert sorted(pairs) == sorted(x * 32000 + y for x, y in w[3])


def test_gallop_finds_what_is_there():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 500):
        rising = np.sort(rng.choice(4 * n, n, replace=False))
        rising[-1] = 4 * n
        wanted = rng.integers(0, 4 * n, 300)
        start = np.searchsorted(rising, wanted // 2)
        found = token_align.gallop(wanted, rising, start, np.full(300, n))
        assert (found == np.isin(wanted, rising)).all()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert token_align.alignment_report(docs, queries.TOKENIZER, queries.PIECE_MODEL, scratch_path(spark, "t")).collect() == []
