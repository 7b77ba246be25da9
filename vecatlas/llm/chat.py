"""Chat formatting: a state machine over roles checks the order of turns, a template turns them into segments.

Every turn becomes three segments: its header, its text (control strings escaped) and its end mark, each with a
loss flag. Which roles there are, how they are marked, which carry loss and which may follow which is data
(``ChatTemplate``), not code.

Turns of a conversation are sorted by turn, then role, then text, so ties and repeated turns have one order.
Null roles and texts are empty (an empty role is a role that may not follow any other, nor begin), a null conversation id is a conversation of its own. Conversations are hash
partitioned and streamed in order: a task holds one turn at a time, however long a conversation is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENTS = "conv_id long, position long, part string, role string, text string, loss boolean, valid boolean"


@dataclass(frozen=True)
class ChatTemplate:
    """``headers`` marks known roles; another role gets ``other`` with its escaped name in it.

    ``order`` maps each state (the last role; None at the start) to the roles that may follow; ``final`` are the
    roles a conversation may end with. ``controls`` are the strings that are escaped inside texts and names.
    """

    headers: dict[str, str] = field(default_factory=lambda: {
        "system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "})
    other: tuple[str, str] = ("### Role ", ": ")
    end: str = " </turn>\n"
    controls: tuple[str, ...] = ("### ", " </turn>", ": ")
    loss_roles: frozenset[str] = frozenset({"assistant"})
    order: dict[str | None, frozenset[str]] = field(default_factory=lambda: {
        None: frozenset({"system", "user"}), "system": frozenset({"user"}),
        "user": frozenset({"assistant"}), "assistant": frozenset({"user"})})
    final: frozenset[str] = frozenset({"assistant"})

    def __post_init__(self):
        marks = [*self.headers.values(), self.other[0]]
        if any(a.startswith(b) for i, a in enumerate(marks) for j, b in enumerate(marks) if i != j):
            raise ValueError("no header may begin with another one")

    def escape(self, text: str) -> str:
        """A backslash before each backslash and each control string, so no mark appears bare."""
        marks = "|".join(re.escape(c) for c in ("\\", *self.controls))
        return re.sub(f"(?={marks})", r"\\", text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)

    def segments(self, role: str, text: str) -> list[tuple[str, str, bool]]:
        header = self.headers.get(role) or self.escape(role).join(self.other)
        return [("header", header, False), ("text", self.escape(text), role in self.loss_roles), ("end", self.end, False)]

    def read(self, formatted: str) -> tuple[str, str]:
        """Role and text of one formatted turn, with its end mark."""
        body = formatted.removesuffix(self.end)
        for role, header in self.headers.items():
            if body.startswith(header):
                return role, self.unescape(body[len(header):])
        name, text = re.fullmatch(_up_to(self.other[1]) + "(.*)", body[len(self.other[0]):], re.S).groups()
        return self.unescape(name), self.unescape(text)

    def turns(self, parts: Iterator[str]) -> Iterator[str]:
        """Cut a stream of formatted text at its bare end marks."""
        whole, held = re.compile(_up_to(self.end), re.S), ""
        for part in parts:
            held += part
            while held.endswith(self.end) and (found := whole.match(held)):
                yield found[0]
                held = held[found.end():]
        if held:
            raise ValueError("formatted text ends inside a turn")


def _up_to(mark: str) -> str:
    """A pattern for all before the first bare mark (as a group) and the mark; it never goes back, so it takes linear time."""
    first, whole = re.escape(mark[0]), re.escape(mark)
    return rf"((?:[^\\{first}]++|\\.|(?!{whole}){first})*+){whole}"


def in_order(turns: DataFrame) -> DataFrame:
    """The turns of each conversation in one partition, in order."""
    tidy = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return tidy.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_conversations(turns: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """Segments (conv_id, position, part, role, text, loss, valid) of all conversations, in order.

    ``position`` counts a conversation's segments from 0; joining their texts in that order gives the formatted
    conversation. ``valid`` is false from a turn that may not follow its predecessor to that turn's end.
    """
    template = template or ChatTemplate()

    def run(batches):
        last, state, position = ..., None, 0
        for batch in batches:
            out = {name: [] for name in ("conv_id", "position", "part", "role", "text", "loss", "valid")}
            for conv, _, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if conv != last:
                    last, state, position = conv, None, 0
                valid = role in template.order.get(state, frozenset())
                state = role
                for part, piece, loss in template.segments(role, text):
                    for name, value in zip(out, (conv, position, part, role, piece, loss, valid)):
                        out[name].append(value)
                    position += 1
            yield pa.RecordBatch.from_pydict(out, schema=_SEGMENT_SCHEMA)

    return in_order(turns).mapInArrow(run, SEGMENTS)


def read_back(segments: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """What the formatted text and its loss mask hold: one row per conversation, read from the segments in order.

    The segments must come as ``format_conversations`` leaves them (whole conversations in order in a partition).
    ``conversation_valid`` also asks that the last role may end a conversation.
    """
    template = template or ChatTemplate()

    def run(batches):
        def rows():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        def summary(conv, stream):
            seen = {"formatted": 0, "loss": 0, "valid": True}
            turn_digest, loss_digest = hashlib.sha256(), hashlib.sha256()

            def parts():
                for _, _, _, _, text, loss, valid in stream:
                    seen["formatted"] += len(text)
                    seen["valid"] &= valid
                    if loss:
                        plain = template.unescape(text)
                        seen["loss"] += len(plain)
                        loss_digest.update(plain.encode())
                    yield text

            n, role = 0, ""
            for turn in template.turns(parts()):
                role, text = template.read(turn)
                turn_digest.update(f"{role}\n{text}\n".encode())
                n += 1
            return (conv, n, turn_digest.hexdigest(), seen["loss"], loss_digest.hexdigest(), seen["formatted"],
                    seen["valid"] and role in template.final)

        held = []
        for conv, stream in groupby(rows(), key=lambda row: row[0]):
            held.append(summary(conv, stream))
            if len(held) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _READ_SCHEMA)], schema=_READ_SCHEMA)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _READ_SCHEMA)], schema=_READ_SCHEMA)

    return segments.mapInArrow(run, READ)


READ = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
        "conversation_valid boolean")
_ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
_SEGMENT_SCHEMA, _READ_SCHEMA = (
    pa.schema([(name, _ARROW[kind]) for name, kind in (x.split() for x in ddl.split(", "))]) for ddl in (SEGMENTS, READ))
