"""Chat formatting with typed content parts.

A visitor flattens the parts of every turn (text, image, audio, document) into
one string with an ordered placeholder per attachment, recording what each
placeholder stands for and the tokens it expands to.  Texts are escaped, so the
template's control strings never come from a text, and can be read back.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
OTHER = "<|attachment|>"  # a part of any other type
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
LEARNED_ROLE = "assistant"
MOST_SECONDS = 1e9  # a longer recording (or an infinite one) has no known length

# Control strings of this template and of common others: none survives in a text as it stands.
_CONTROL = re.compile(r"\\|<(?=\||/?s>|</?SYS>>|/?SYS>)|\[(?=/?INST\])")
_BREAK = re.compile(r"\\|<(?=\|)|\n")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_PLACEHOLDER = re.compile("|".join(re.escape(p) for p in (*PLACEHOLDERS.values(), OTHER)))  # escaped texts hold none
_HEADER = re.compile(r"((?:[^\\\n]|\\.)*)\n", re.DOTALL)


def escape(text: str) -> str:
    """A backslash doubles; a control string gets one after its first character."""
    return _CONTROL.sub(lambda m: "\\\\" if m.group() == "\\" else m.group() + "\\", text)


def escape_role(role: str) -> str:
    """As a text, and a line break (it would end the header) follows a backslash."""
    return _BREAK.sub(lambda m: "<\\" if m.group() == "<" else "\\" + m.group(), role)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


class Flattener:
    """Visits the parts of a conversation in order and writes its text."""

    def __init__(self, tile: int = 28, audio_rate: float = 25.0, page_tokens: int = 800):
        self.tile, self.audio_rate, self.page_tokens = tile, audio_rate, page_tokens
        self.out: list[str] = []
        self.at = 0
        self.text: list[str] = []  # parts of a text that is not yet written
        self.loss: list[dict] = []
        self.attachments: list[dict] = []

    def write(self, text: str) -> None:
        self.out.append(text)
        self.at += len(text)

    def flush(self) -> None:
        """Neighbouring texts are escaped as one, or a control string could be put together from them."""
        if self.text:
            self.write(escape("".join(self.text)))
            self.text = []

    def visit(self, turn: int, k: int, part: dict | None) -> None:
        kind = (part or {}).get("type") or "text"
        if kind == "text":
            self.visit_text(part)
        else:
            self.flush()
            tokens = getattr(self, f"tokens_of_{kind}")(part) if kind in PLACEHOLDERS else 0
            self.attachments.append({"turn": turn, "part": k, "kind": kind, "ref": part["ref"], "start": self.at, "tokens": max(1, tokens)})
            self.write(PLACEHOLDERS.get(kind, OTHER))

    def visit_text(self, part: dict | None) -> None:
        self.text.append((part or {}).get("text") or "")

    def tokens_of_image(self, part: dict) -> int:
        return math.ceil(max(part["width"] or 0, 0) / self.tile) * math.ceil(max(part["height"] or 0, 0) / self.tile)

    def tokens_of_audio(self, part: dict) -> int:
        seconds = part["seconds"] or 0.0
        return math.ceil(seconds * self.audio_rate) if 0 < seconds <= MOST_SECONDS else 0

    def tokens_of_document(self, part: dict) -> int:
        return (part["pages"] or 0) * self.page_tokens

    def turn(self, number: int, role: str, parts: list[dict | None]) -> None:
        self.write(f"{TURN}{escape_role(role)}\n")
        start = self.at
        for k, part in enumerate(parts):
            self.visit(number, k, part)
        self.flush()
        if role == LEARNED_ROLE:
            self.loss.append({"start": start, "end": self.at})
        self.write(f"{END}\n")


def text_part(text: Column) -> Column:
    """The parts of a turn that is one plain text."""
    null = F.lit(None)
    return F.array(
        F.struct(
            F.lit("text").alias("type"), F.coalesce(text.cast("string"), F.lit("")).alias("text"), null.cast("string").alias("ref"),
            null.cast("int").alias("width"), null.cast("int").alias("height"), null.cast("double").alias("seconds"), null.cast("int").alias("pages"),
        )
    )


def format_chat(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """One row per conversation: its formatted text, loss mask, attachments and expanded tokens.

    ``parts`` is array<PART>.  Returns ``key``, formatted string, loss
    array<struct<start,end>> (code points under the mask: assistant bodies),
    attachments array<struct<turn,part,kind,ref,start,tokens>> in order and
    attachment_tokens bigint.  Turns go by number, ties by role and parts, a
    null number first; equal rows stay as turns of their own.  Null parts and
    null texts are empty, a null role is '', a part without a type is a text.
    Rows of a null key form one conversation.  A part of another type becomes
    ``OTHER`` and an attachment of its kind.  An attachment has one token at
    least, also where its size is null, negative, not a number or without end.
    Neighbouring text parts are escaped together.  A conversation is one
    value of the result, so its turns meet in one task; nothing larger does.
    """
    kind = turns.schema[key].dataType.simpleString()
    gathered = turns.select(
        F.col(key).alias("_key"),
        F.struct(
            F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(parts).cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>")).alias("parts"),
        ).alias("t"),
    ).groupBy("_key").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    attachment = pa.struct([("turn", pa.int64()), ("part", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("start", pa.int64()), ("tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                made = []
                for rows in piece.column("turns").to_pylist():
                    visitor = Flattener()
                    for row in rows:
                        visitor.turn(row["turn"], row["role"], row["parts"])
                    made.append(visitor)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("_key"), pa.array(["".join(v.out) for v in made], pa.string()), pa.array([v.loss for v in made], pa.list_(span)),
                        pa.array([v.attachments for v in made], pa.list_(attachment)), pa.array([sum(a["tokens"] for a in v.attachments) for v in made], pa.int64()),
                    ],
                    names=[key, "formatted", "loss", "attachments", "attachment_tokens"],
                )

    return gathered.mapInArrow(
        run,
        f"`{key}` {kind}, formatted string, loss array<struct<start:bigint,end:bigint>>, "
        "attachments array<struct<turn:bigint,part:bigint,kind:string,ref:string,start:bigint,tokens:bigint>>, attachment_tokens bigint",
    )


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation: role and text, unescaped."""
    turns = []
    for piece in formatted.split(f"{END}\n")[:-1]:
        header = _HEADER.match(piece, len(TURN))
        turns.append((unescape(header[1]), unescape(piece[header.end() :])))
    return turns


def read_parts(formatted: str) -> list[tuple[str, list[str | None]]]:
    """The turns with their contents: texts, unescaped, and None for each placeholder in its place."""
    turns = []
    for piece in formatted.split(f"{END}\n")[:-1]:
        header = _HEADER.match(piece, len(TURN))
        body, parts, at = piece[header.end() :], [], 0
        for m in _PLACEHOLDER.finditer(body):
            parts += [unescape(body[at : m.start()]), None]
            at = m.end()
        turns.append((unescape(header[1]), [p for p in [*parts, unescape(body[at:])] if p != ""]))
    return turns


def read_back(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """Digests read from the formatted text and its loss mask alone.

    Returns ``key``, n_turns, turns_sha256, loss_chars, loss_sha256 and
    formatted_chars.  A null text has no turns.
    """
    kind = formatted.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, loss in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist()):
                turns = read_turns(text or "")
                masked = "".join(unescape(text[s["start"] : s["end"]]) for s in loss or ())
                rows.append(
                    (
                        len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                        len(masked), hashlib.sha256(masked.encode()).hexdigest(), len(text or ""),
                    )
                )
            names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=[key, *names])

    return formatted.select(key, "formatted", "loss").mapInArrow(
        run, f"`{key}` {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )
