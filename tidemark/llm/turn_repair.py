"""Repair of broken conversations by the cheapest edits, found with the auction shortest-path algorithm.

The edits of a conversation are paths through a lattice: a node is a number of rows done and what
the last turn kept was (nothing, system, user, assistant); arcs keep, re-role or delete a row, or
insert an empty turn, at whole costs. Every node has a price, at first 0, which never exceeds an
arc's cost plus the price of the arc's end. A path grows from its origin along arcs at which this
is an equality (extension); where there is none, the last node's price rises until there is, and the
path gives the node back (contraction). When the path reaches the end, the origin's price is its
distance. Among the arcs that converged prices leave tight, the edits are traced by the least
letter, so that ties have one result.

Prices rise in steps, so work grows with length times cost. Long conversations are therefore
auctioned in blocks of ``BLOCK`` rows from the last on, each block ending in the converged prices of the next.

Texts cross the network once. What decides the edits, one letter a row, is gathered beforehand
from digests; then each conversation streams through its task in order, row by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 3, 4, 3, 3
BLOCK = 16
BLANKS = " \t\n\x0b\x0c\r"
#: What may follow, by what was kept last: the initials of roles, and the one that edits give.
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER_KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
TURN_BY_EDIT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}


def _arcs(row: str, state: int) -> tuple[tuple[str, int, int, int], ...]:
    """(letter, cost, rows taken, state) of the arcs from a state before a row (``""`` after the last), letters ascending."""
    then, extra = TURN_BY_EDIT[state], UNFINISHED if row.isupper() else 0
    out = [("D", DELETE, 1, state)] if row else []
    out.append(("I", INSERT, 0, then))
    if row not in ("", "-"):
        kept = AFTER_KEEP.get((state, row.lower()))
        if kept is not None:
            out.append(("K", KEEP + extra, 1, kept))
        out.append(("R", REROLE + extra, 1, then))
    return tuple(out)


ARCS = {row: tuple(_arcs(row, state) for state in range(4)) for row in ("", *"-suaxSUAX")}


class Lattice:
    """The lattice of one conversation, given as a letter a row: the role's initial (``x`` for
    roles that fit nowhere), upper case if truncated, ``-`` for a row that has to go."""

    def __init__(self, rows: str) -> None:
        self.n = len(rows)
        self.arcs = [*(ARCS[row] for row in rows), ARCS[""]]
        self.price = [[0, 0, 0, 0] for _ in range(self.n + 1)]
        for state in range(4):
            self.converge(self.n, state, self.n + 1)
        # blocks from the last row on; the least price at a block's end is below all distances in it
        for end in range(self.n, 0, -BLOCK):
            begin, least = max(0, end - BLOCK), min(self.price[end])
            for i in range(begin, end):
                self.price[i] = [least] * 4
            for state in range(4):
                self.converge(begin, state, end)
        self.cost = self.price[0][START]

    def converge(self, i: int, state: int, end: int) -> None:
        """The auction from one node to the layer ``end``, whose prices are final: afterwards its price is its distance."""
        price, arcs, n, path = self.price, self.arcs, self.n, []
        while i != end and not (i == n and state in (START, ASSISTANT)):
            least = None
            for _, cost, taken, to in arcs[i][state]:
                there = cost + price[i + taken][to]
                if least is None or there < least:
                    least, j, then = there, i + taken, to
            if price[i][state] < least:  # contraction
                price[i][state] = least
                if path:
                    i, state = path.pop()
            else:  # extension
                path.append((i, state))
                i, state = j, then

    def trace(self) -> str:
        """The letters of the cheapest edits, the ASCII-least ones among equals."""
        price, i, state, out = self.price, 0, START, []
        while not (i == self.n and state in (START, ASSISTANT)):
            end = self.n - (self.n - 1 - i) // BLOCK * BLOCK if i < self.n else self.n + 1
            for letter, cost, taken, to in self.arcs[i][state]:
                if price[i][state] == cost + price[i + taken][to]:
                    self.converge(i + taken, to, end)  # a price off the paths may be too low yet
                    if price[i][state] == cost + price[i + taken][to]:
                        out.append(letter)
                        i, state = i + taken, to
                        break
            else:
                raise AssertionError("a converged node has a tight arc")
        return "".join(out)


def cheapest_edits(rows: str) -> tuple[int, str]:
    lattice = Lattice(rows)
    return lattice.cost, lattice.trace()


@lru_cache(50_000)
def known_edits(rows: str) -> tuple[int, str]:
    """Of short conversations, whose letters recur."""
    return cheapest_edits(rows)


def turn_states(edits: str, rows: str) -> Iterator[tuple[str, int | None]]:
    """Each edit with the state that it leads to; None for rows deleted."""
    state, i = START, 0
    for letter in edits:
        if letter == "K":
            state = AFTER_KEEP[state, rows[i].lower()]
        elif letter != "D":
            state = TURN_BY_EDIT[state]
        i += letter != "I"
        yield letter, None if letter == "D" else state


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` broken by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2
    takes its ``.!?`` away, 3 repeats it, 4 makes its role user. Null roles and texts, and null parts of the key, are one space."""
    rows = turns.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    conv_id, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    key = F.concat(conv_id, F.lit(":"), turn)
    rows = rows.withColumn("_kind", F.crc32(key.cast("binary")) % 20).where("_kind != 0")
    kind = F.col("_kind")
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(copies).alias("_copy"),
    ).drop("_copy")


def _given(turns: DataFrame) -> DataFrame:
    """The rows with null roles and texts as one space, and a digest of both."""
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    return rows.withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)))


ORDER = ("turn", "role", "digest")


def _letters(rows: DataFrame) -> DataFrame:
    """One short row a turn: its fault and letter; texts stay behind."""
    stripped = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    first = Window.partitionBy("conv_id", "digest").orderBy(F.col("turn").asc_nulls_first())
    return (
        rows.select(
            "conv_id", *ORDER, initial.alias("initial"), (F.length(stripped) == 0).alias("blank"),
            (~F.substring(stripped, -1, 1).isin(".", "!", "?")).alias("unfinished"))
        .withColumn("copy", F.row_number().over(first))
        .select(
            "conv_id", *ORDER, "initial", "copy",
            F.when(F.col("blank"), "b").when(F.col("copy") > 1, "d").when(F.col("unfinished"), "t").otherwise("").alias("fault"))
    )


def _by_conversation(rows: DataFrame, *order: Column) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *order)


def _row_letter(initial: str, fault: str) -> str:
    if fault in ("b", "d"):
        return "-"
    letter = initial if initial in ("s", "u", "a") else "x"
    return letter.upper() if fault == "t" else letter


def plan_edits(turns: DataFrame) -> DataFrame:
    """Per conversation: ``gaps blank duplicate truncated illegal cost`` (longs), ``audit`` and ``letters``.

    Rows are taken by turn, nulls first, rows of one turn by role, then by a digest of role and
    text; repeated rows are duplicates. ``letters`` has one letter a row, which is all of a
    conversation that its task holds. An empty table gives none.
    """
    kinds = {f: k for k, f in enumerate("bdt")}
    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, letters string"
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, open_ = None, False
        faults, illegal, before = [0, 0, 0], 0, None
        letters: list[str] = []
        low = high = last = None
        distinct = 0
        out: list[tuple] = []

        def close() -> None:
            rows = "".join(letters)
            cost, audit = known_edits(rows) if len(rows) <= 64 else cheapest_edits(rows)
            gaps = 0 if low is None else high - low + 1 - distinct
            out.append((conv, gaps, *faults, illegal, cost, audit, rows))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault")]
            for conv_id, turn, initial, fault in zip(*columns, strict=True):
                if not open_ or conv_id != conv:
                    if open_:
                        close()
                    conv, open_ = conv_id, True
                    faults, illegal, before, letters = [0, 0, 0], 0, None, []
                    low = high = last = None
                    distinct = 0
                if turn is not None:
                    low = turn if low is None else low
                    distinct += turn != last
                    high = last = turn
                if fault:
                    faults[kinds[fault]] += 1
                illegal += before is not None and before + initial not in ("su", "ua", "au")
                before = initial
                letters.append(_row_letter(initial, fault))
            if len(out) >= 1000:
                yield _batch(out, names)
                out.clear()
        if open_:
            close()
        yield _batch(out, names)

    order = (F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("copy"))
    return _by_conversation(_letters(_given(turns)), *order).select("conv_id", "turn", "initial", "fault").mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    types = {"conv_id": pa.int64(), "audit": pa.string(), "letters": pa.string(), "role": pa.string(), "text": pa.string(), "edit": pa.string(),
             "repaired_sha256": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.int64())) for c, n in zip(columns, names, strict=True)], names=names)


def repaired(turns: DataFrame, plans: DataFrame, keep_turns: bool = True) -> DataFrame:
    """The repaired turns, ``conv_id position role text edit``, in order, and a closing row for each
    conversation that has ``repaired_sha256``: of ``role:text`` of its turns, newline-joined.

    ``plans`` are those of :func:`plan_edits` for the same ``turns``. A conversation's edits come
    first in its stream, then its rows one by one, so its texts are never held together.
    """
    schema = T.StructType.fromDDL("conv_id long, position long, role string, text string, edit string, repaired_sha256 string")
    names = schema.names
    given = _given(turns)
    none = F.lit(None)
    heads = plans.select(
        "conv_id", F.lit(0).alias("_part"), none.cast("long").alias("turn"), F.lit("").alias("role"), none.cast("binary").alias("digest"),
        F.concat_ws(" ", F.concat(F.lit("="), "audit"), "letters").alias("text"))
    body = given.select("conv_id", F.lit(1).alias("_part"), *ORDER, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, steps, digest, position = None, None, None, 0
        out: list[tuple] = []

        def turn(role: str, text: str, edit: str) -> None:
            nonlocal position
            digest.update(f"{chr(10) if position else ''}{role}:{text}".encode())
            if keep_turns:
                out.append((conv, position, role, text, edit, None))
            position += 1

        def take(role: str, text: str, is_row: bool) -> None:
            """The edits up to the next row's own; at the end, all that are left."""
            for letter, state in steps:
                if letter == "I":
                    turn(ROLE_OF[state], "", "I")
                    continue
                if letter != "D":
                    turn(role if letter == "K" else ROLE_OF[state], text, letter)
                if is_row:
                    return

        def close() -> None:
            take("", "", False)
            out.append((conv, position, None, None, None, digest.hexdigest()))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "_part", "role", "text")]
            for conv_id, part, role, text in zip(*columns, strict=True):
                if part == 0:
                    if steps is not None:
                        close()
                    audit, rows = text[1:].split(" ")
                    conv, steps, digest, position = conv_id, turn_states(audit, rows), hashlib.sha256(), 0
                else:
                    take(role, text, True)
            yield _batch(out, names)
            out.clear()
        if steps is not None:
            close()
        yield _batch(out, names)

    order = (F.col("_part"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"))
    return _by_conversation(heads.unionByName(body), *order).select("conv_id", "_part", "role", "text").mapInArrow(run, schema)
