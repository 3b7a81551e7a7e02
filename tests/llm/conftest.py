from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"

# Texts with the odd cases: null, empty, blanks, long, non-ASCII, markers, repeats.
TEXTS = [
    None,
    "",
    "   \n\t ",
    "word",
    "The MIT License and the Apache License. GNU General Public License, general-public license",
    "a b c d e a b c d e a b c d e\n\nline one\nline one\nline two\n" * 3,
    "x" * 5000,
    "y " * 9000,
    "Éa ß ü 日本語 🦊 \x00\x01 <s> </s> [INST] ▁▁ {image 0} \\ <|endoftext|>",
    "Same text twice, Same text twice.",
    "Same text twice, Same text twice.",
    "A  b   c \r\n d\x0be\x0cf\u00a0g\u2003h",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts, a repeated row, a null id, and extra columns whose names clash with the operators' own."""
    rows = [(i, t, "en", "s", 0, "kept", 1) for i, t in enumerate(TEXTS)]
    rows += [rows[4], (None, "null id text", None, None, None, None, None)]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, found string, n_words int"
    ).repartition(3)


@pytest.fixture(scope="session")
def sf_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def by_id(rows, *names):
    """doc_id -> values, for rows with distinct ids."""
    out = {}
    for r in rows:
        assert r["doc_id"] not in out or out[r["doc_id"]] == tuple(r[n] for n in names)
        out[r["doc_id"]] = tuple(r[n] for n in names)
    return out
