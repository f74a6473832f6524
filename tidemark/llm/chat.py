"""Chat formatting: a finite-state machine over roles, segments with loss flags, and reading back.

Rows are dealt by conversation and sorted by turn; a task then streams through them with the
state of one conversation at a time, so that a conversation of any length needs no more memory
than its longest turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START = ""


@dataclass(frozen=True)
class Template:
    """How turns are marked, which strings are control strings, and which role may follow which.

    A control string inside a text gets a backslash after its first character, and one that
    has backslashes there gets one more; so texts never contain a control string, and taking
    one backslash away restores them. First characters must not occur elsewhere in a control
    string, or occurrences could overlap.
    """

    open: str = "<|im_start|>"
    middle: str = "<|im_sep|>"
    close: str = "<|im_end|>"
    other_control: tuple[str, ...] = ("<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
    loss_roles: tuple[str, ...] = ("assistant",)
    follows: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: {
        START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        control = (self.open, self.middle, self.close, *self.other_control)
        firsts = {c[:1] for c in control}
        if any(len(c) < 2 or firsts & set(c[1:]) or "\\" in c for c in control):
            raise ValueError("control strings need two characters, no backslash, and first characters that occur nowhere else")

    @property
    def pattern(self) -> str:
        """Matches a control string, with any number of backslashes after its first character."""
        control = (self.open, self.middle, self.close, *self.other_control)
        return "|".join(rf"{re.escape(c[0])}\\*{re.escape(c[1:])}" for c in control)

    def escape(self, text: str) -> str:
        return re.sub(self.pattern, lambda m: m[0][0] + "\\" + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return re.sub(self.pattern, lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)

    def step(self, state: str | None, role: str) -> str | None:
        """The state after a turn; None once a role was out of order."""
        return role if state is not None and role in self.follows.get(state, ()) else None


CHAT = Template()
SEGMENTS = "turn_no long, segment int, text string, loss boolean, in_order boolean"


def format_segments(conversations: DataFrame, template: Template = CHAT) -> DataFrame:
    """Segments of ``conversations(conv_id, turn, role, text)``, streaming in order within tasks.

    Rows: ``conv_id``, ``turn_no`` (from 0), ``segment`` (0 mark and role, 1 text, 2 mark),
    ``text``, ``loss``, ``in_order`` (false from the first turn on whose role may not follow).
    All turns are formatted, also of conversations out of order. A null text or role counts as
    empty. Turns go by ``turn``, nulls first, then role and text, so that repeated rows are
    turns of their own; rows without conv_id are one conversation.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = (
        conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .repartition("conv_id").sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, turn = object(), START, 0
        for batch in batches:
            out = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv != now:
                    now, state, turn = conv, START, 0
                state = template.step(state, role)
                loss, good = role in template.loss_roles, state is not None
                out += [
                    (conv, turn, 0, template.open + template.escape(role) + template.middle, False, good),
                    (conv, turn, 1, template.escape(text), loss, good),
                    (conv, turn, 2, template.close, False, good),
                ]
                turn += 1
            types = (batch.schema.field("conv_id").type, pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_())
            names = ("conv_id", "turn_no", "segment", "text", "loss", "in_order")
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)

    return rows.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {kind}, {SEGMENTS}")


class Reader:
    """Reads one conversation back from its formatted text and loss mask."""

    def __init__(self, conv, template: Template) -> None:
        self.conv, self.template = conv, template
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.pending: list[tuple[str, bool]] = []
        self.state: str | None = START

    def feed(self, text: str, loss: bool) -> None:
        self.formatted_chars += len(text)
        self.pending.append((text, loss))
        if text.endswith(self.template.close):
            self._turn()

    def _turn(self) -> None:
        t = self.template
        whole = "".join(text for text, _ in self.pending)
        head, _, body = whole.removesuffix(t.close).partition(t.middle)
        role, text = t.unescape(head.removeprefix(t.open)), t.unescape(body)
        self.state = t.step(self.state, role)
        self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        masked = t.unescape("".join(text for text, loss in self.pending if loss))
        self.loss.update(masked.encode("utf-8", "surrogatepass"))
        self.loss_chars += len(masked)
        self.n_turns += 1
        self.pending = []

    def row(self) -> tuple:
        valid = self.state is not None and self.state in self.template.final
        return (self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars, valid)


DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def read_back(segments: DataFrame, template: Template = CHAT) -> DataFrame:
    """What :func:`format_segments` says of each conversation, parsed from its text and mask.

    The segments have to come as that function gives them, each conversation in order in one
    partition; those read from a table are for :func:`read_stored`.
    ``valid``: every role followed in order and the last one may end a conversation.
    """
    kind = segments.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        key = None

        def table(done: list[Reader]) -> pa.RecordBatch:
            rows = [r.row() for r in done]
            types = (key, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            names = ("conv_id", *(part.split()[0] for part in DIGEST.split(", ")))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

        for batch in batches:
            key, done = batch.schema.field("conv_id").type, []
            for conv, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss")), strict=True):
                if reader is None or conv != reader.conv:
                    done += [reader] if reader is not None else []
                    reader = Reader(conv, template)
                reader.feed(text, loss)
            yield table(done)
        if reader is not None:
            yield table([reader])

    return segments.select("conv_id", "text", "loss").mapInArrow(run, f"conv_id {kind}, {DIGEST}")


def read_stored(segments: DataFrame, template: Template = CHAT) -> DataFrame:
    """:func:`read_back` of segments in any order and partitions, which it gathers and sorts first."""
    order = (F.col("conv_id").asc_nulls_first(), F.col("turn_no"), F.col("segment"))
    return read_back(segments.repartition("conv_id").sortWithinPartitions(*order), template)
