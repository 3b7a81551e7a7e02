"""Chat formatting with typed content parts, a reversible template, and a loss mask.

A turn's content is a plain text or a JSON list of typed parts, as in
``[{"type": "text", "text": "…"}, {"type": "image", "url": "…", "width": 640, "height": 480}]``
(types text, image, audio, document). A visitor flattens the parts in order: text stays
text, any other part becomes a numbered placeholder, and an attachment row records what it
refers to and how many tokens it will take. Only columns of ``parts`` kind are parsed; a
text that merely looks like JSON stays text unless ``typed=True``.

The template is ``<s>`` (start of a conversation), then for each turn
``[TURN role]text[/TURN]``, and ``</s>`` after the last turn. Inside roles and texts a
backslash and every ``<``, ``[`` and ``{`` are preceded by a backslash, so no control
string can occur there and the text can be read back exactly. The loss mask covers the
(escaped) text of assistant turns.

A conversation is formatted turn by turn in one ordered pass that holds one turn at a
time: rows are partitioned by conversation and sorted by turn, a digest runs along, and
nothing is collected. (A digest is sequential, so one conversation is one task's work,
but never its memory.)

Defined cases: a null text is empty, a null role is the empty role; turns of equal number
are ordered by role and text; nulls in conv_id form a conversation of their own; an empty
table has no conversation; further columns are ignored. A content that is no JSON list of objects is plain text. A
part of an unknown type becomes an attachment of kind ``other`` with 0 tokens; a size that is no finite number of at
least 0 (also one given as text that is none) counts as missing; a text or reference that is no string is
taken as its JSON text. With ``strict`` an unknown type is an error instead.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import column

OPEN, CLOSE, TURN, TURN_END = "<s>", "</s>", "[TURN ", "[/TURN]"
LEARNT_ROLE = "assistant"
_TO_ESCAPE = re.compile(r"[\\<\[{\]]")
_ESCAPED = re.compile(r"\\(.)", re.S)

# What a part expands to: square patches of an image, seconds of audio, pages of a document.
PATCH, TOKENS_PER_SECOND, TOKENS_PER_PAGE = 28, 25, 512


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


# No attachment is larger; greater sizes count as missing, like other impossible ones.
_LARGEST = 1e9


def _number(value) -> float | None:
    """A size as a number, also if it is given as text; None if it is none."""
    try:
        number = float(value) if isinstance(value, (int, float, str)) and not isinstance(value, bool) else -1.0
    except (ValueError, OverflowError):
        return None
    return number if 0 <= number <= _LARGEST else None


def _text(value) -> str | None:
    """A string as it is (halves of surrogate pairs replaced), other values as JSON; None stays."""
    if value is None:
        return None
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return text.encode("utf-8", "replace").decode()


@dataclass
class Flattened:
    """Escaped text with placeholders, and the attachments in their order."""

    text: str = ""
    attachments: list[dict] = field(default_factory=list)


class PartVisitor:
    """Visits typed parts in order; one method for each type."""

    def __init__(self, first: int = 0, strict: bool = False):
        self.out, self.first, self.strict = Flattened(), first, strict

    def visit(self, part: dict) -> None:
        kind = part.get("type", "text")
        method = getattr(self, f"visit_{kind}", None)
        if method is None and self.strict:
            raise ValueError(f"unknown part type: {kind}")
        (method or self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self.out.text += escape(_text(part.get("text")) or "")

    def visit_image(self, part: dict) -> None:
        across, down = (math.ceil((_number(part.get(side)) or PATCH) / PATCH) for side in ("width", "height"))
        self._attach("image", part, across * down)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil((_number(part.get("seconds")) or 0) * TOKENS_PER_SECOND))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, math.ceil(_number(part.get("pages")) or 1) * TOKENS_PER_PAGE)

    def visit_other(self, part: dict) -> None:
        self._attach("other", part, 0)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        number = self.first + len(self.out.attachments)
        self.out.text += "{" + f"{kind} {number}" + "}"
        self.out.attachments.append({"number": number, "kind": kind, "ref": _text(part.get("url") or part.get("ref")), "tokens": tokens})


def flatten(content: str | None, typed: bool = False, first: int = 0, strict: bool = False) -> Flattened:
    """A turn's content as escaped text with placeholders; ``first`` is the number of its first attachment."""
    visitor = PartVisitor(first, strict)
    parts = None
    if typed and content and content.lstrip().startswith("["):
        try:
            parts = json.loads(content)
        except (ValueError, RecursionError):
            parts = None
        if not (isinstance(parts, list) and all(isinstance(p, dict) for p in parts)):
            parts = None
    for part in parts if parts is not None else [{"type": "text", "text": content or ""}]:
        visitor.visit(part)
    return visitor.out


def format_turn(role: str | None, content: str | None, is_first: bool, typed: bool = False, attached: int = 0) -> tuple[str, int, int, list[dict]]:
    """Formatted turn, loss mask [from, to) in it (empty unless the role is learnt), attachments."""
    flat = flatten(content, typed, attached)
    head = (OPEN if is_first else "") + TURN + escape(role or "") + "]"
    start = len(head)
    stop = start + len(flat.text) if role == LEARNT_ROLE else start
    return head + flat.text + TURN_END, start, stop, flat.attachments


def format_turns(conversations: DataFrame, typed: bool = False) -> DataFrame:
    """One row for each turn, in order: formatted text, its place in the conversation's text, the loss mask
    (places in the conversation's text), attachments. The last turn also has the closing mark.

    Columns: conv_id, seq, formatted, start, mask_first, mask_last, attachments.
    """
    rows = (
        conversations.select(
            F.col("conv_id").cast("bigint").alias("conv_id"),
            F.col("turn").cast("bigint").alias("turn"),
            F.col("role").cast("string").alias("role"),
            F.col("text").cast("string").alias("text"),
        )
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )
    kind = pa.list_(pa.struct([("number", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))
    names = ["conv_id", "seq", "formatted", "start", "mask_first", "mask_last", "attachments"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last turn waits, as the next row tells whether the conversation goes on
        at = attached = seq = 0

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            out = []
            for conv, role, text in zip(*(column(batch, n).to_pylist() for n in ("conv_id", "role", "text")), strict=True):
                same = held is not None and held[0] == conv
                if held is not None:
                    out.append(held if same else (*held[:2], held[2] + CLOSE, *held[3:]))
                if not same:
                    at = attached = seq = 0
                made, first, last, parts = format_turn(role, text, not same, typed, attached)
                held = (conv, seq, made, at, at + first, at + last, parts)
                at, attached, seq = at + len(made), attached + len(parts), seq + 1
            if out:
                yield pack(out)
        if held is not None:
            yield pack([(*held[:2], held[2] + CLOSE, *held[3:])])

    schema = (
        "conv_id bigint, seq bigint, formatted string, start bigint, mask_first bigint, mask_last bigint, "
        "attachments array<struct<number:bigint,kind:string,ref:string,tokens:bigint>>"
    )
    return rows.mapInArrow(run, schema)


_TURN_HEAD = re.compile(r"(?:<s>)?\[TURN ((?:[^\\\]]|\\.)*)\]", re.S)


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn (texts without attachments come back exactly)."""
    head = _TURN_HEAD.match(formatted)
    body = formatted[head.end() :]
    body = body[: -len(CLOSE)] if body.endswith(TURN_END + CLOSE) else body
    return unescape(head[1]), unescape(body[: -len(TURN_END)])


def read_back(turns: DataFrame) -> DataFrame:
    """Digests of each conversation, from its formatted turns and loss masks alone.

    Columns: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_attachments, attachment_tokens.
    """
    rows = turns.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "attachment_tokens"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    class Running:
        def __init__(self, conv):
            self.conv, self.turns, self.loss_chars, self.chars, self.parts, self.tokens = conv, 0, 0, 0, 0, 0
            self.all, self.loss = hashlib.sha256(), hashlib.sha256()

        def add(self, formatted, start, first, last, parts):
            role, text = parse_turn(formatted)
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            masked = unescape(formatted[first - start : last - start])
            self.loss.update(masked.encode("utf-8", "surrogatepass"))
            self.turns, self.chars, self.loss_chars = self.turns + 1, self.chars + len(formatted), self.loss_chars + len(masked)
            self.parts, self.tokens = self.parts + len(parts), self.tokens + sum(p["tokens"] for p in parts)

        def row(self):
            return (self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.parts, self.tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            done = []
            wanted = ("conv_id", "formatted", "start", "mask_first", "mask_last", "attachments")
            for conv, *rest in zip(*(column(batch, n).to_pylist() for n in wanted), strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.row())
                    now = Running(conv)
                now.add(*rest)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(now.row(), kinds, strict=True)], names=names)

    schema = (
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint, n_attachments bigint, attachment_tokens bigint"
    )
    return rows.mapInArrow(run, schema)
