from __future__ import annotations

import re

import numpy as np

from tidewatch.llm.common import hashed_words


def test_word_hashes_tell_words_apart_and_find_their_texts():
    texts = [b"", b" ab ba\tAB \x0b abc", b"\n", "é e  x".encode(), b"x" * 300, b"a"]
    words, starts = hashed_words(texts)
    want = [re.findall(rb"[^\x20\x09-\x0d]+", t.lower()) for t in texts]
    assert starts.tolist() == np.cumsum([0] + [len(w) for w in want]).tolist()
    flat = [w for ws in want for w in ws]
    assert len(words) == len(flat) and all((a == b) == (x == y) for a, x in zip(flat, words) for b, y in zip(flat, words))
    many = [str(i) for i in range(200_000)]
    assert len(np.unique(hashed_words([" ".join(many).encode()])[0])) == len(many)
