"""Texts cut into parts that a tokenizer treats independently of each other, and caches of what is known of parts.

``cut`` finds the places in numpy and leaves equal parts to Arrow's dictionary encoding, so Python sees each
different part of a chunk once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa

CACHE_PARTS = 300_000
_LONG_PART = 64

# A byte that certainly starts a character which is no white space: above the blank, and no first byte of
# a character that may be Unicode white space.
_SOLID = np.zeros(256, bool)
_SOLID[0x21:] = True
_SOLID[[0xC2, 0xE1, 0xE2, 0xE3]] = False
_ASCII_SOLID = np.zeros(256, bool)
_ASCII_SOLID[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


@dataclass
class Cut:
    """The different parts of some texts, which part stands where, and where each text's parts begin (one more)."""

    parts: list[bytes]
    index: np.ndarray
    starts: np.ndarray


def cut(texts: list[bytes], stops: bool = False) -> Cut:
    """Cut before each single blank that a solid character follows, and around single line feeds between solid characters.

    With ``stops`` a full stop or comma between an ASCII letter and a blank or line feed is parted from the letter, too.
    Patterns in the manner of ``\\s+(?!\\S)|\\s+| ?\\p{L}+`` start anew at all these places.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.cumsum([0] + [len(t) for t in texts])
    if not len(data):
        return Cut([], np.zeros(0, np.int64), np.zeros(len(bounds), np.int64))
    here = np.zeros(len(data) + 1, bool)
    here[bounds[:-1]] = True
    solid, before, after = _SOLID[data], data[:-2], data[2:]
    middle = data[1:-1]
    here[1:-2] |= (middle == 32) & (before != 32) & solid[2:]
    feeds = (middle == 10) & _ASCII_SOLID[before] & solid[2:]
    here[1:-2] |= feeds
    here[2:-1] |= feeds
    if stops:
        here[1:-2] |= ((middle == 46) | (middle == 44)) & _LETTER[before] & ((after == 32) | (after == 10))
    here[-1] = False
    places = np.flatnonzero(here)
    offsets = np.append(places, len(data)).astype(np.int32)
    column = pa.Array.from_buffers(pa.binary(), len(places), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    known = column.dictionary_encode()
    return Cut(known.dictionary.to_pylist(), known.indices.to_numpy(), np.searchsorted(places, bounds))


class Known:
    """What was learnt of parts, in two generations: when the young one is full it becomes the old one, and what is
    used again moves back, so frequent parts stay. Very long parts are not kept."""

    def __init__(self, learn: Callable[[list[bytes]], list[Any]], size: int = CACHE_PARTS):
        self.learn, self.size = learn, size
        self.young: dict[bytes, Any] = {}
        self.old: dict[bytes, Any] = {}

    def of(self, parts: list[bytes]) -> list[Any]:
        """What is known of each of the (different) parts."""
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}
            for p in [p for p in self.old if len(p) > _LONG_PART]:
                del self.old[p]
        young = self.young
        lacking = [p for p in parts if p not in young]
        if lacking:
            new = []
            for p in lacking:
                again = self.old.get(p)
                if again is None:
                    new.append(p)
                else:
                    young[p] = again
            if new:
                young.update(zip(new, self.learn(new), strict=True))
        return [young[p] for p in parts]


class ByteLevel:
    """A byte-level tokenizer that encodes many parts in few calls.

    Parts are written one after the other as far as the tokenizer would cut between them anyway: directly before a blank and a
    solid character, with a line feed between solid characters. The sizes of the tokens tell where a part's ids end.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.tokens = byte_level_tokens(tokenizer)
        self.sizes = None if self.tokens is None else np.array([len(t) for t in self.tokens], np.int64)

    def _each(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in parts], add_special_tokens=False)]
        ends = np.cumsum([len(x) for x in got], dtype=np.int64)
        return np.fromiter((i for ids in got for i in ids), np.int64, int(ends[-1]) if len(ends) else 0), ends

    def encode(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts one after the other, and where each part's ids end."""
        if self.sizes is None or not parts:
            return self._each(parts)
        solid, closed, blank = _SOLID.tolist(), _ASCII_SOLID.tolist(), 32
        text: list[bytes] = []
        ends = np.zeros(len(parts), np.int64)
        at, feeds, alone = 0, [], []
        last = False  # whether the text so far ends in a solid ASCII character
        for i, p in enumerate(parts):
            spaced = len(p) > 1 and p[0] == blank and solid[p[1]]
            if not closed[p[-1]] or not (spaced or solid[p[0]]) or (text and not spaced and not last):
                alone.append(i)
                ends[i] = -1
                continue
            if text and not spaced:
                text.append(b"\n")
                at += 1
                feeds.append(at)
            text.append(p)
            at += len(p)
            ends[i] = at
            last = True
        flat = np.array(self.tokenizer.encode_batch_fast([b"".join(text).decode()], add_special_tokens=False)[0].ids if text else [], np.int64)
        reach = np.cumsum(self.sizes[flat])
        drop = np.searchsorted(reach, feeds)
        own = np.flatnonzero(ends >= 0)
        stop = np.searchsorted(reach, ends[own]) + 1
        if len(flat) and (int(reach[-1]) != at or (reach[drop] != feeds).any() or (reach[stop - 1] != ends[own]).any()):
            return self._each(parts)  # not the tokenizer this was made for
        keep = np.ones(len(flat), bool)
        keep[drop] = False
        kept = np.append(0, np.cumsum(keep))
        joined, joined_ends = flat[keep], kept[stop]
        if not alone:
            return joined, joined_ends
        other, other_ends = self._each([parts[i] for i in alone])
        sizes = np.zeros(len(parts), np.int64)
        sizes[own], sizes[alone] = np.diff(joined_ends, prepend=0), np.diff(other_ends, prepend=0)
        of = np.repeat(np.isin(np.arange(len(parts)), alone), sizes)
        out = np.zeros(int(sizes.sum()), np.int64)
        out[~of], out[of] = joined, other
        return out, np.cumsum(sizes)


def byte_level_tokens(tokenizer) -> list[bytes] | None:
    """The bytes of each entry of a byte-level vocabulary, or None if it is not one.

    The printable stand-ins for bytes are a fixed convention: printable Latin-1 characters stand for themselves, the other
    bytes for characters from U+0100 in order. Added tokens stand for their own text.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in plain}
    table |= {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    added = set(tokenizer.get_added_tokens_decoder())
    out = []
    for i in range(tokenizer.get_vocab_size()):
        entry = tokenizer.id_to_token(i) or ""
        if i not in added and any(c not in table for c in entry):
            return None
        out.append(entry.encode() if i in added else bytes(table[c] for c in entry))
    return out
