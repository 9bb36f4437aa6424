"""Chat formatting of typed content parts.

A turn holds a list of parts: text, image, audio or document. A visitor
flattens them in order into one formatted segment, with a placeholder for every
attachment, and records the attachments' references, places and expanded token
counts, and the spans of text that a loss mask covers. A conversation is its
segments in the order of its turns; segments stay rows, so that no conversation
has to fit into one row.

Control strings begin with ``<|``. Inside texts and roles, every ``<`` with any
number of backslashes and a ``|`` behind it gets one more backslash, so no
control string can arise, and taking one away restores the text. Text parts in a row are escaped as one text, as
a control string may be cut in two by them; they are one span of the loss mask as well.

Defined results: a null text, part list or role counts as empty; a part of
unknown kind counts as text; equal turn numbers are ordered by role, then
segment; null conversation ids form one conversation; extra columns are dropped.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PART_TYPE = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
TURN_TYPE = (
    "struct<segment:string,loss:array<struct<begin:int,end:int>>,"
    "attachments:array<struct<kind:string,ref:string,place:int,tokens:bigint>>,expanded_tokens:bigint>"
)


@dataclass(frozen=True)
class Expansion:
    """Tokens that an attachment's placeholder stands for."""

    patch: int = 28
    audio_per_second: float = 25.0
    per_page: int = 256


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def escape_after(text: str, opened: bool) -> tuple[str, bool]:
    """``text`` escaped behind a text that ends in ``<`` and backslashes, if ``opened``; and whether both together do."""
    closes = opened and re.match(r"\\*\|", text)
    still = re.search(r"<\\*\Z", text) or opened and not text.strip("\\")
    return "\\" * bool(closes) + escape(text), bool(still)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclass
class Flattener:
    """Visits the parts of one turn."""

    role: str
    expansion: Expansion
    pieces: list[str] = field(default_factory=list)
    length: int = 0
    loss: list[dict] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    opened: bool = False  # whether the text so far ends in what may begin a control string

    def put(self, piece: str) -> None:
        self.pieces.append(piece)
        self.length += len(piece)

    def visit(self, part: dict) -> None:
        handler = getattr(self, f"visit_{part.get('kind')}", self.visit_text)
        handler(part)

    def visit_text(self, part: dict) -> None:
        begin = self.length
        escaped, self.opened = escape_after(part.get("text") or "", self.opened)
        self.put(escaped)
        if self.role == "assistant" and self.length > begin:
            if self.loss and self.loss[-1]["end"] == begin:
                begin = self.loss.pop()["begin"]
            self.loss.append({"begin": begin, "end": self.length})

    def visit_image(self, part: dict) -> None:
        side = lambda n: max(1, math.ceil((n or 0) / self.expansion.patch))
        self.attach(part, side(part.get("width")) * side(part.get("height")))

    def visit_audio(self, part: dict) -> None:
        self.attach(part, max(1, math.ceil((part.get("seconds") or 0) * self.expansion.audio_per_second)))

    def visit_document(self, part: dict) -> None:
        self.attach(part, max(1, part.get("pages") or 0) * self.expansion.per_page)

    def attach(self, part: dict, tokens: int) -> None:
        self.attachments.append({"kind": part["kind"], "ref": part.get("ref"), "place": self.length, "tokens": tokens})
        self.put(f"<|{part['kind']}|>")
        self.opened = False

    def turn(self, parts: list[dict]) -> dict:
        self.put(f"{START}{escape_role(self.role)}\n")
        for part in parts:
            self.visit(part or {})
        self.put(f"{END}\n")
        return {
            "segment": "".join(self.pieces), "loss": self.loss, "attachments": self.attachments,
            "expanded_tokens": sum(a["tokens"] for a in self.attachments),
        }


def text_part(text: Column) -> Column:
    """A turn of plain text as a list of one part."""
    empty = lambda kind: F.lit(None).cast(kind)
    return F.array(F.struct(
        F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), empty("string").alias("ref"),
        empty("int").alias("width"), empty("int").alias("height"), empty("double").alias("seconds"),
        empty("int").alias("pages"),
    ))


def format_turns(turns: DataFrame, expansion: Expansion = Expansion()) -> DataFrame:
    """conv_id, turn, segment, loss, attachments and expanded_tokens of every turn; ``turns`` has conv_id, turn, role
    and parts (array of PART_TYPE). Places are code points from the segment's start."""

    @F.arrow_udf(TURN_TYPE)
    def flatten(roles: pa.Array, parts: pa.Array) -> pa.Array:
        rows = [
            Flattener(role or "", expansion).turn(content or [])
            for role, content in zip(roles.to_pylist(), parts.to_pylist(), strict=True)
        ]
        span = pa.struct([("begin", pa.int32()), ("end", pa.int32())])
        attached = pa.struct([("kind", pa.string()), ("ref", pa.string()), ("place", pa.int32()), ("tokens", pa.int64())])
        return pa.array(rows, pa.struct([
            ("segment", pa.string()), ("loss", pa.list_(span)), ("attachments", pa.list_(attached)),
            ("expanded_tokens", pa.int64()),
        ]))

    flat = turns.select("conv_id", "turn", flatten("role", "parts").alias("flat"))
    return flat.select("conv_id", "turn", "flat.*")


def read_segment(segment: str) -> tuple[str, str]:
    """Role and body, still escaped, of a formatted segment."""
    role, _, body = segment[len(START):-len(END) - 1].partition("\n")
    return unescape_role(role), body


class Digest:
    """Running digests of one conversation, read back from its segments."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.n_turns, self.loss_chars, self.formatted_chars = conv_id, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str, spans: list[dict]) -> None:
        role, body = read_segment(segment)
        self.n_turns += 1
        self.formatted_chars += len(segment)
        self.turns.update(f"{role}\n{unescape(body)}\n".encode())
        for span in spans:
            text = unescape(segment[span["begin"]:span["end"]])
            self.loss_chars += len(text)
            self.loss.update(text.encode())

    def row(self) -> dict:
        return {
            "conv_id": self.conv_id, "n_turns": self.n_turns, "turns_sha256": self.turns.hexdigest(),
            "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(),
            "formatted_chars": self.formatted_chars,
        }


DIGEST_SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
])


def _digest_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over rows in order; a conversation of any length costs the memory of one batch."""
    current = None
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if current is None or current.conv_id != row["conv_id"]:
                if current is not None:
                    done.append(current.row())
                current = Digest(row["conv_id"])
            current.add(row["segment"], row["loss"])
        if done:
            yield pa.RecordBatch.from_pylist(done, DIGEST_SCHEMA)
    if current is not None:
        yield pa.RecordBatch.from_pylist([current.row()], DIGEST_SCHEMA)


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """What reading every conversation back from its segments gives."""
    ordered = (
        formatted.select(F.col("conv_id").cast("long"), "turn", "segment", "loss")
        .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")
        .select("conv_id", "segment", "loss")
    )
    return ordered.mapInArrow(
        _digest_sorted,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
