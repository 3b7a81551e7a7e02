"""SentencePiece encoding and decoding with byte spans of the original text.

Normalisation replaces, at each place, the longest prefix that the model's compiled
character map knows, and notes for each normalised byte the original byte it came from;
then spaces are squeezed (if the model says so), escaped, and the dummy prefix is put in
front. The model's own merges cut the result into pieces, and the recorded alignment
projects every piece to bytes of the original.

Pieces never reach across the start of a run of escaped spaces (checked when a model is
opened; a model for which this is not so is fed whole texts), so words are cut once and
kept in a cache of bounded size. The library merges, and decodes.

Defined cases: null is the empty text, whose ids are the begin and end ids only; equal
rows give equal results; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from tidewatch.llm.common import chunks, column

CACHE_WORDS = 200_000
_SPACE = "▁"
_LONG_WORD = 64


class CharacterMap:
    """The compiled map of a model: a double-array trie of byte strings, and their replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of ``data[at:]`` and what replaces it."""
        if not self.units:
            return None
        units, found = self.units, None
        unit = units[0]
        node = (unit >> 10) << ((unit & (1 << 9)) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
            if (unit >> 8) & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\x00", found[1])]


def _character_length(first: int) -> int:
    return 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


class Codec:
    """A model opened for encoding with spans, and for decoding."""

    def __init__(self, model_file: str, cache_words: int = CACHE_WORDS):
        proto = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.treat_whitespace_as_suffix or not spec.escape_whitespaces:
            raise ValueError("models with spaces as suffixes or without escaped spaces are not supported")
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.whole = sentencepiece.SentencePieceProcessor(model_file=model_file)
        # The same merges over text that is already normalised.
        spec.precompiled_charsmap, spec.name = b"", "identity"
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.merges = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.by_word = not any(
            _SPACE in p.piece.lstrip(_SPACE) for p in proto.pieces if p.type in (1, 4)
        ) and not any(p.type == 4 for p in proto.pieces)
        self.begin, self.end = self.whole.bos_id(), self.whole.eos_id()
        # Bytes of normalised text that a piece stands for; a byte piece stands for one, the unknown for its character.
        self.sizes = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.unknown = self.whole.unk_id()
        self.words: dict[str, tuple[bytes, bytes]] = {}
        self.cache_words = cache_words

    # Normalisation

    def normalised(self, data: bytes) -> tuple[str, np.ndarray]:
        """Normalised text, and for each of its bytes (and its end) the original offset."""
        if not self.map.units and not self.squeeze:
            return self._identity(data)
        out, origin = bytearray(), []
        at = 0
        while at < len(data):
            known = self.map.longest(data, at)
            size, new = known if known else (_character_length(data[at]), data[at : at + _character_length(data[at])])
            out += new
            origin += [at] * len(new)
            at += size
        origin.append(len(data))
        if self.squeeze:
            keep = [i for i, c in enumerate(out) if c != 32 or (i and out[i - 1] != 32)]
            while keep and out[keep[-1]] == 32:
                keep.pop()
            end = origin[keep[-1] + 1] if keep else len(data)
            origin = [origin[i] for i in keep] + [end]
            out = bytearray(out[i] for i in keep)
        return self._escaped(bytes(out), np.array(origin, np.int64))

    def _identity(self, data: bytes) -> tuple[str, np.ndarray]:
        return self._escaped(data, np.arange(len(data) + 1, dtype=np.int64))

    def _escaped(self, data: bytes, origin: np.ndarray) -> tuple[str, np.ndarray]:
        if not data:
            return "", origin[-1:]
        width = np.where(np.frombuffer(data, np.uint8) == 32, 3, 1)
        aligned = np.repeat(origin[:-1], width)
        front = np.full(3 if self.prefix else 0, origin[0], np.int64)
        text = data.decode("utf-8", "surrogatepass").replace(" ", _SPACE)
        return (_SPACE if self.prefix else "") + text, np.concatenate([front, aligned, origin[-1:]])

    # Encoding

    def _learn(self, words: list[str]) -> dict[str, tuple[bytes, bytes]]:
        """Ids and sizes (in normalised bytes) of the pieces of each word."""
        cut = self.merges.encode(words, num_threads=1)
        flat = np.fromiter((i for ids in cut for i in ids), np.uint32, sum(map(len, cut)))
        ends = np.cumsum([len(ids) for ids in cut]) * 4
        all_ids, all_sizes = flat.tobytes(), self.sizes[flat].astype(np.uint32).tobytes()
        learnt, start = {}, 0
        for word, end in zip(words, ends.tolist(), strict=True):
            learnt[word] = all_ids[start:end], all_sizes[start:end]
            start = end
        for word, ids in zip(words, cut, strict=True):
            if self.unknown in ids:  # without byte fallback a run of unknown characters is one piece
                pieces = self.merges.encode(word, out_type=str, num_threads=1)
                learnt[word] = learnt[word][0], np.array([len(p.encode()) for p in pieces], np.uint32).tobytes()
        return learnt

    def _words(self, text: str) -> list[str]:
        if not self.by_word:
            return [text]
        head, *rest = text.split(_SPACE)
        if "" not in rest:
            return ([head] if head else []) + [_SPACE + w for w in rest]
        return re.findall(f"{_SPACE}*[^{_SPACE}]+|{_SPACE}+$", text)

    def ids_and_sizes(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pieces of normalised texts."""
        known = self.words
        if len(known) > self.cache_words:
            known.clear()
        cut = [self._words(t) for t in texts]
        new = list({w for words in cut for w in words if w not in known})
        fresh = self._learn(new) if new else {}
        known.update((w, v) for w, v in fresh.items() if len(w) <= _LONG_WORD)
        for words in cut:
            got = [known.get(w) or fresh[w] for w in words]
            yield (
                np.frombuffer(b"".join([g[0] for g in got]), np.uint32),
                np.frombuffer(b"".join([g[1] for g in got]), np.uint32),
            )

    def encode(self, texts: list[bytes], marks: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text its ids, and from which to which byte of the original each piece reaches.

        With ``marks`` the begin and end ids stand around them, with empty spans.
        """
        normal = [self.normalised(t) for t in texts]
        cut = self.ids_and_sizes([t for t, _ in normal])
        for data, (_, origin), (ids, sizes) in zip(texts, normal, cut, strict=True):
            edges = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            first, last = origin[edges[:-1]], origin[edges[1:]]
            if marks:
                ids = np.concatenate([[self.begin], ids, [self.end]]).astype(np.uint32)
                first, last = np.concatenate([[0], first, [len(data)]]), np.concatenate([[0], last, [len(data)]])
            yield ids, first, last

    def decode(self, ids: np.ndarray) -> str:
        return self.whole.decode(ids.tolist())


_open: dict[str, Codec] = {}


def codec(model_file: str) -> Codec:
    """The model, opened once in each Python worker."""
    if model_file not in _open:
        _open[model_file] = Codec(model_file)
    return _open[model_file]


def encode_documents(docs: DataFrame, model_file: str, spans: bool = True) -> DataFrame:
    """doc_id, ids, and (if wanted) first_byte and last_byte of each piece in the original text."""
    schema = "doc_id bigint, ids array<bigint>" + (", first_byte array<bigint>, last_byte array<bigint>" if spans else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(model_file)
        for batch, texts in chunks(batches):
            rows = list(use.encode(texts))
            parts = [pa.array([r[i].astype(np.int64) for r in rows], pa.list_(pa.int64())) for i in range(3 if spans else 1)]
            names = ["doc_id", "ids", "first_byte", "last_byte"][: 1 + len(parts)]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *parts], names=names)

    return _id_and_text(docs).mapInArrow(run, schema)


def decode_documents(rows: DataFrame, model_file: str) -> DataFrame:
    """doc_id and the text of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(model_file)
        for batch in batches:
            texts = [use.whole.decode(ids or []) for ids in column(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids").mapInArrow(run, "doc_id bigint, text string")


DIGEST_SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_bytes_covered bigint"


def round_trip_digests(docs: DataFrame, model_file: str) -> DataFrame:
    """Encode and decode every text in one pass; digests of the ids and of the decoded text, and how many
    original bytes the pieces' spans cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(model_file)
        for batch, texts in chunks(batches):
            out = []
            for ids, first, last in use.encode(texts):
                text = use.decode(ids)
                out.append(
                    (
                        len(ids),
                        hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
                        hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(),
                        int((last - first).sum()),
                    )
                )
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes_covered"],
            )

    return _id_and_text(docs).mapInArrow(run, DIGEST_SCHEMA)


def _id_and_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
