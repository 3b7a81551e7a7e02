"""The per-document operators against plain Python over the same texts."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib

import numpy as np

import pytest

from tests.llm.conftest import SF, by_id
from tidewatch.llm import chat_format, decontaminate, license_scan, pieces, quality_rules, queries, token_files
from tidewatch.session import scratch_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
STRICT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(params=["odd", "sf", "none"])
def docs(request, odd_docs, sf_docs):
    return {"odd": odd_docs, "sf": sf_docs, "none": odd_docs.limit(0)}[request.param]


def texts_of(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


# SentencePiece


def test_pieces_match_the_library(docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    want = {}
    for doc, text in texts_of(docs).items():
        ids = library.encode(text, add_bos=True, add_eos=True)
        blob = struct.pack(f"<{len(ids)}I", *ids)
        want[doc] = (len(ids), hashlib.sha256(blob).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    rows = pieces.round_trip_digests(docs, queries.PIECE_MODEL).collect()
    assert len(rows) == docs.count()
    assert by_id(rows, "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_piece_spans_tile_the_text(odd_docs):
    texts = texts_of(odd_docs)
    for r in pieces.encode_documents(odd_docs, queries.PIECE_MODEL).collect():
        spans = list(zip(r["first_byte"], r["last_byte"]))
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert spans[0][0] == 0 and spans[-1][1] == len(texts[r["doc_id"]].encode())


def test_decode_documents(odd_docs):
    rows = pieces.decode_documents(pieces.encode_documents(odd_docs, queries.PIECE_MODEL, spans=False), queries.PIECE_MODEL)
    got = by_id(rows.collect(), "text")
    assert got[3] == ("word",) and got[0] == ("",)


def test_character_map_equals_the_library():
    """A compiled map that a library brings along (nothing is trained): normalised texts, and where each byte came from."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(library.serialized_model_proto())
    codec = pieces.Codec(queries.PIECE_MODEL)
    codec.map = pieces.CharacterMap(proto.normalizer_spec.precompiled_charsmap)
    codec.prefix, codec.squeeze = proto.normalizer_spec.add_dummy_prefix, proto.normalizer_spec.remove_extra_whitespaces
    rng = random.Random(9)
    marks = ["a", "b", " ", "  ", "\t", "ﬁ", "①", "é", "e\u0301", "ｶﾞ", "２", "㍿", "\u200b", "\u00ad", "가", "\u1112\u1161\u11ab", "𝐀", "🦊", "日本", "\u3000", "½"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(30))) for _ in range(3000)]
    for text in texts:
        got, origin = codec.normalised(text.encode())
        assert got == library.normalize(text), text
        data = text.encode()
        assert len(origin) == len(got.encode()) + 1
        assert all(a <= b for a, b in zip(origin, origin[1:])) and (not got or origin[-1] <= len(data))
        assert all(o == len(data) or data[o] & 0xC0 != 0x80 for o in origin.tolist())  # places of whole characters


def test_character_map_takes_the_longest_prefix():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    known = pieces.CharacterMap(proto.normalizer_spec.precompiled_charsmap)
    composed = "e\u0301x".encode()
    assert known.longest(composed, 0) == (3, "é".encode())  # not the one of "e" alone
    assert known.longest(b"ab", 0) is None and pieces.CharacterMap(b"").longest(composed, 0) is None


# Quality rules


def quality_base(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    from collections import Counter

    n = Counter(windows)
    hit = {i + j for i, w in enumerate(windows) if n[w] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_quality_measures(docs):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rows = quality_rules.measured(docs).collect()
    assert len(rows) == docs.count()
    assert by_id(rows, *names) == {d: quality_base(t) for d, t in texts_of(docs).items()}
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and not r["broken_rules"])


def test_quality_is_one_projection_without_python(sf_docs):
    plan = quality_rules.measured(sf_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_quality_keeps_good_and_drops_bad(spark, sf_docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality_rules.measured(sf_docs).join(labels, "doc_id").collect()
    good = [r for r in rows if r["quality"] == 1 and not r["base_failed"]]
    bad = [r for r in rows if r["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.97 * len(good) and sum(r["kept"] for r in bad) <= 0.1 * len(bad)


# License scans


def license_base(text):
    words = STRICT.findall(low(text))
    places = []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_license_base(docs):
    rows = license_scan.scan(docs).collect()
    assert len(rows) == docs.count()
    assert by_id(rows, "n_words", "n_base", "first_word", "last_word", "base_labels") == {d: license_base(t) for d, t in texts_of(docs).items()}
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in rows)


def test_license_notice_with_a_gap(spark):
    notice = license_scan.TEMPLATES[7].text.split()
    changed = notice[:10] + ["very", "much"] + notice[10:30] + notice[31:]
    text = "one two " + " ".join(changed) + " three"
    docs = spark.createDataFrame([(1, text), (2, " ".join(notice[:9])), (3, text + " four " + text)], "doc_id bigint, text string")
    got = by_id(license_scan.scan(docs).collect(), "labels", "n_base")
    assert got == {1: ("mit", 0), 2: ("", 0), 3: ("mit", 0)}
    places = license_scan.spans(license_scan._text_hits(docs, license_scan.TEMPLATES).where("size(hits) > 0")).where("doc_id = 3").count()
    assert places == 2


# Decontamination


def test_decontamination(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    extra = spark.createDataFrame([(900, "Same text twice"), (901, None), (902, "word"), (902, "word")], "item_id bigint, text string")
    items = [(str(r[0]), STRICT.findall(low(r[1] or ""))) for r in bench.union(extra).collect()]

    def plain(text):
        words = STRICT.findall(low(text))
        hit, ids = set(), set()
        for item, w in items:
            for s in range(max(1, len(w) - 12) if w else 0):
                part = w[s : s + 13]
                for i in range(len(words) - len(part) + 1):
                    if words[i : i + len(part)] == part:
                        hit |= set(range(i, i + len(part)))
                        ids.add(item)
        return len(words), len(hit), tuple(sorted(ids)), len(hit) > 0 and 20 * len(hit) >= len(words)

    some = docs.where("length(text) < 3000 or text is null") if docs.count() > 50 else docs
    rows = decontaminate.scan(some, bench.union(extra)).collect()
    got = {r["doc_id"]: (r["n_words"], sum(x["last"] - x["first"] for x in r["runs"]), tuple(r["items"]), r["contaminated"]) for r in rows}
    texts = texts_of(some)
    assert got == {d: plain(t) for d, t in texts.items()}
    for r in rows:
        data = texts[r["doc_id"]].encode()
        for run, span in zip(r["runs"], r["spans"]):
            words = STRICT.findall(low(data[span["first"] : span["last"]].decode()))
            assert words == STRICT.findall(low(texts[r["doc_id"]]))[run["first"] : run["last"]]
    kept = decontaminate.decontaminated(docs, bench.union(extra))
    assert kept.columns == docs.columns
    if docs is some:
        assert kept.count() == sum(not r["contaminated"] for r in rows)


def test_decontamination_in_blocks(spark, sf_docs, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = sorted(map(str, decontaminate.scan(sf_docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "PATTERN_BYTES", 100_000)
    assert len(decontaminate._item_blocks(bench, 13)) > 1
    assert sorted(map(str, decontaminate.scan(sf_docs, bench).collect())) == want


# Token files


def test_token_files(spark, docs, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "FILE_IDS", 5000)
    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in docs.collect()))
    want, start = [], 0
    for there, doc, text in rows:
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        want.append((doc if there else None, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    manifest = token_files.write_token_files(docs, queries.TOKENIZER, scratch_path(spark, "test-tokens"), 2)
    got = [tuple(r) for r in token_files.read_token_files(spark, manifest).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    first = manifest.orderBy("part", "file").first()
    if first:
        assert len(token_files.document_ids(first["path"], 0)) == want[0][2]


# Chat format


def conversation_digests(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv), key=lambda x: x)
        all_ = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        out[conv] = (len(turns), hashlib.sha256(all_.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_round_trip(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-5, 0, "us]er\\", "</s>[INST] <s>[TURN x] \\[/TURN] {image 1}"), (-5, 1, "assistant", None), (-5, 1, "assistant", "b[/TURN]</s>"), (None, 3, None, "x")]
    made = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    turns = chat_format.format_turns(made)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat_format.read_back(turns).collect()}
    assert got == conversation_digests(rows)
    assert chat_format.read_back(chat_format.format_turns(made.limit(0))).count() == 0


def test_chat_query_has_the_probe(spark):
    rows = {r["conv_id"]: r for r in queries.op10_chat_format(spark, SF).collect()}
    probe = "</s>[INST] ok [/INST]"
    assert rows[-1]["loss_chars"] == len(probe) and rows[-1]["loss_sha256"] == hashlib.sha256(probe.encode()).hexdigest()


def test_chat_typed_parts():
    content = '[{"type":"text","text":"see <a>"},{"type":"image","url":"u1","width":57,"height":28},{"type":"audio","ref":"u2","seconds":2},{"type":"document","url":"u3","pages":3}]'
    flat = chat_format.flatten(content, typed=True, first=4)
    assert flat.text == "see \\<a>{image 4}{audio 5}{document 6}"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in flat.attachments] == [("image", "u1", 3), ("audio", "u2", 50), ("document", "u3", 1536)]
    assert chat_format.flatten("[not json", typed=True).text == "\\[not json"
    assert np.all([chat_format.unescape(chat_format.escape(x)) == x for x in ("\\", "[]{}<>", "\\\\[", "a\nb")])
    with pytest.raises(ValueError):
        chat_format.flatten('[{"type":"video"}]', typed=True, strict=True)


@pytest.mark.parametrize(
    ("part", "text", "kind", "tokens"),
    [
        ('{"type":"video","url":"v"}', "{other 0}", "other", 0),
        ('{"type":null}', "{other 0}", "other", 0),
        ('{"type":["image"]}', "{other 0}", "other", 0),
        ('{"type":"image","width":"56","height":"x"}', "{image 0}", "image", 2),
        ('{"type":"image","width":-5,"height":true}', "{image 0}", "image", 1),
        ('{"type":"image","width":1e400,"height":[28]}', "{image 0}", "image", 1),
        ('{"type":"audio","seconds":"1.5"}', "{audio 0}", "audio", 38),
        ('{"type":"audio","seconds":{}}', "{audio 0}", "audio", 0),
        ('{"type":"document","pages":null,"url":{"a":1}}', "{document 0}", "document", 512),
        ('{"type":"text","text":{"a":"<"}}', '\\{"a": "\\<"}', None, None),
        ('{"text":"half \\ud800 pair"}', "half ? pair", None, None),
    ],
)
def test_chat_bad_parts_have_a_result(spark, part, text, kind, tokens):
    flat = chat_format.flatten(f"[{part}]", typed=True)
    assert flat.text == text
    assert [(a["kind"], a["tokens"]) for a in flat.attachments] == ([(kind, tokens)] if kind else [])


def test_chat_bad_rows_do_not_end_the_job(spark):
    deep = "[" * 100_000
    contents = ['[{"type":"video"}]', '[{"type":"image","width":"w","url":7}]', '["no object"]', "[1", deep, None, '[{"text":"\\ud800"}]']
    rows = spark.createDataFrame([(1, i, "user", c) for i, c in enumerate(contents)] + [(None, 0, None, "x"), (None, 0, None, "x")], "conv_id bigint, turn int, role string, text string")
    turns = chat_format.format_turns(rows, typed=True).collect()
    assert len(turns) == len(contents) + 2
    assert [(a["kind"], a["ref"]) for t in sorted(turns, key=lambda t: (t["conv_id"] or 0, t["seq"])) for a in t["attachments"]] == [("other", None), ("image", "7")]
