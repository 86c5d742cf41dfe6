"""Chat formatting: typed content parts, a reversible template, a loss mask, and a streamed read-back."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from palimpsest.llm.common import arrow_map, col

START, TEXT, END = "<|start|>", "<|text|>", "<|end|>"

#: Control strings: the template's own, and those of other templates that a tokenizer may know.
_CONTROL = r"(?=\||/s>|s>|/?INST\]|/?SYS>)"
_escape = re.compile(r"([<\[])(\\*)" + _CONTROL)
_unescape = re.compile(r"([<\[])\\(\\*)" + _CONTROL)
_turn = re.compile(re.escape(START) + r"(.*?)" + re.escape(TEXT) + r"(.*?)" + re.escape(END), re.S)
_placeholder = re.compile(r"<\|(?:image|audio|document|file):\d+\|>")


def escape(text: str) -> str:
    """One backslash more after the bracket of each control string, so that none is left; unescape() takes it away."""
    return _escape.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _unescape.sub(r"\1\2", text)


def texts_of(body: str) -> str:
    """The texts of a turn's content, without its placeholders; each stretch between these was escaped by itself."""
    return "".join(map(unescape, _placeholder.split(body)))


PART_TYPE = T.StructType([T.StructField(n, t) for n, t in (("type", T.StringType()), ("text", T.StringType()), ("ref", T.StringType()), ("width", T.LongType()), ("height", T.LongType()), ("seconds", T.DoubleType()), ("pages", T.LongType()))])
ATTACHMENT = T.StructType([T.StructField(n, t) for n, t in (("position", T.IntegerType()), ("kind", T.StringType()), ("ref", T.StringType()), ("tokens", T.LongType()))])


@dataclass
class PartVisitor:
    """Walks the parts of one turn in order; collects escaped text and placeholders, attachments and token counts.

    image: one token per patch; audio: tokens_per_second; document: tokens_per_page. A size that is missing counts
    as 0 tokens. A part of another type is a `file` without tokens; a null part is skipped.
    """

    patch: int = 28
    tokens_per_second: float = 25.0
    tokens_per_page: int = 1024
    pieces: list[str] = field(default_factory=list)
    open: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict | None) -> None:
        if part is not None:
            {"text": self.visit_text, "image": self.visit_image, "audio": self.visit_audio, "document": self.visit_document}.get(part.get("type"), self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self.open.append(part.get("text") or "")

    def body(self) -> str:
        """The turn's content so far. Text parts that follow each other are escaped as one, so no control string comes about where they meet."""
        if self.open:
            self.pieces.append(escape("".join(self.open)))
            self.open.clear()
        return "".join(self.pieces)

    def visit_image(self, part: dict) -> None:
        self._attach("image", part, math.ceil((part.get("width") or 0) / self.patch) * math.ceil((part.get("height") or 0) / self.patch))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil((part.get("seconds") or 0) * self.tokens_per_second))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, (part.get("pages") or 0) * self.tokens_per_page)

    def visit_other(self, part: dict) -> None:
        self._attach("file", part, 0)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.body()
        self.pieces.append(f"<|{kind}:{len(self.attachments)}|>")
        self.attachments.append({"position": len(self.attachments), "kind": kind, "ref": part.get("ref"), "tokens": int(tokens)})


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", content_col: str = "text", trained_role: str = "assistant") -> DataFrame:
    """One segment per turn: conv, turn, segment, loss_start, loss_end, attachments, expanded_tokens.

    content_col is a string, or an array of parts (PART_TYPE). Segments in the order of turns, joined by nothing, are
    the formatted conversation. loss_start and loss_end are code points of the segment: the content of a turn of
    trained_role, else null. Each row is formatted by itself: nothing is shuffled or gathered.

    Null text, null parts or an empty array: empty. Null role: an empty role. Null conv or turn: kept, as a conversation
    or place of its own. Repeated rows: a segment each. Empty table: no rows. Other columns are not carried.
    """
    rows = turns.select(col(conv_col), col(turn_col), col(role_col).cast("string").alias("__role"), col(content_col).alias("__content"))

    def run(roles: list, contents: list) -> tuple:
        out: tuple = ([], [], [], [], [])
        for role, content in zip(roles, contents, strict=True):
            visitor = PartVisitor()
            for part in [{"type": "text", "text": content}] if content is None or isinstance(content, str) else content:
                visitor.visit(part)
            head, body = f"{START}{escape(role or '')}{TEXT}", visitor.body()
            trained = role == trained_role
            for store, x in zip(out, (head + body + END, len(head) if trained else None, len(head) + len(body) if trained else None, visitor.attachments, sum(a["tokens"] for a in visitor.attachments)), strict=True):
                store.append(x)
        return out

    return arrow_map(rows, run, [("segment", T.StringType()), ("loss_start", T.LongType()), ("loss_end", T.LongType()), ("attachments", T.ArrayType(ATTACHMENT)), ("expanded_tokens", T.LongType())], keep=2)


class _ReadBack:
    """Digests of one conversation, updated segment by segment in constant memory."""

    def __init__(self) -> None:
        self.turns, self.chars, self.loss = 0, 0, 0
        self.turns_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str, start: int | None, end: int | None) -> None:
        self.chars += len(segment)
        for role, body in _turn.findall(segment):
            self.turns += 1
            self.turns_hash.update(f"{unescape(role)}\n{texts_of(body)}\n".encode("utf-8", "surrogatepass"))
        if start is not None:
            text = texts_of(segment[start:end])
            self.loss += len(text)
            self.loss_hash.update(text.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        return self.turns, self.turns_hash.hexdigest(), self.loss, self.loss_hash.hexdigest(), self.chars


READ_BACK = [("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType())]


def read_back(segments: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """One row per conversation, parsed from its segments in order: conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest of a whole conversation needs its turns in order, so they meet in one task; they are sorted on disk and
    streamed through, a batch at a time, so a conversation of any length takes constant memory. Turns with the same
    number follow each other by segment; null turns are first. Conversations with a null id are one conversation.
    """
    kind = segments.schema[conv_col].dataType
    schema = T.StructType([T.StructField(conv_col, kind), *(T.StructField(n, t) for n, t in READ_BACK)])
    rows = segments.select(col(conv_col).alias("__conv"), col(turn_col).alias("__turn"), "segment", "loss_start", "loss_end")
    dealt = rows.repartition("__conv").sortWithinPartitions("__conv", "__turn", "segment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, current, state = to_arrow_schema(schema), None, None

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

        for batch in batches:
            done = []
            for conv, segment, start, end in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if state is None or conv != current:
                    if state is not None:
                        done.append((current, *state.row()))
                    current, state = conv, _ReadBack()
                state.add(segment, start, end)
            if done:
                yield table(done)
        if state is not None:
            yield table([(current, *state.row())])

    return dealt.mapInArrow(run, schema)
