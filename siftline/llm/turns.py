"""Repair of conversations: the cheapest edits that make their roles alternate, by secondary-sorted streaming.

Rows are dealt by conversation and sorted by turn within a partition; one pass streams over them in Arrow batches and
carries the state of a dynamic program from batch to batch, whatever their borders. The program has four states: nothing
said yet, after the system's turn, after a user's, after an assistant's. Per state it holds the least cost, the rank of the
least edits that reach it and a running SHA-256 of the conversation as they leave it, so that no text is kept. States that
another one beats whatever follows are dropped.

How each state was reached takes a byte a row and state. These back-pointers leave the pass in blocks of BLOCK rows, as
rows of its output; Spark sorts them within the partition, last block first, and spills what doesn't fit. A second pass
reads them once and traces the edits. Both passes, and the search for duplicates between them and the shuffle, need that
one shuffle only. A conversation of any length takes one task, as a digest of it must, but no memory beyond a batch, a
block and its own edits.

Edits: K keeps a row (0), R gives it the role user or assistant (3), D deletes it (4; the only one for blank and duplicate
rows), I inserts an empty turn of a user or an assistant (3); a truncated row that stays costs 3 more. Roles count by their
first letter; what remains is nothing, or turns of user and assistant in turn after at most one of the system. Among the
cheapest edits, those least in ASCII are taken.

Defined results: a null role or text is one space; null turns come first; an empty role can't stay; rows that share a turn are taken by role, then
text; a null conversation id is a conversation of its own; a repeated row is a duplicate; texts may be empty (blank) or of any length; a conversation all of whose rows are
absent has counts of 0 and no edits; an empty table gives an empty one; other columns aren't looked at, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, partitions_for, read

#: Rows whose back-pointers are one block.
BLOCK = 1 << 16
KEEP, RENAME, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after the next turn of a user or an assistant, and its role.
_TURN = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_LETTERS = "DKR"
_FILLED = re.compile(r"[^\x20\x09-\x0D]")
_SPACE = " \t\n\x0b\x0c\r"


def _beaten(cost: dict[int, int]) -> set[int]:
    """States that another state is cheaper than by more than it could ever lose: what follows one of them can be
    followed from the other after an insertion or two, or by deleting the system's turn."""
    margins = {START: {ASSISTANT: 4, USER: 7}, SYSTEM: {ASSISTANT: 0, USER: 3, START: 0}, USER: {ASSISTANT: 3}, ASSISTANT: {USER: 3}}
    return {s for s in cost if any(o in cost and cost[s] > cost[o] + m for o, m in margins[s].items())}


@functools.cache
def step(live: tuple, letter: str, faulty: bool, cut: bool) -> tuple[tuple, int, bytes, tuple]:
    """One row: live states in the order of their edits, as (state, cost above the least), to those after the row, what
    the least cost grew by, the back-pointers by state, and the moves (state, from, what goes before the row's text, edit).

    Edits that end in an edit of the same row never begin one another, so that their order is that of the states they
    come from, then of what follows; insertions are tried in front of each edit.
    """
    best: dict[int, tuple] = {}
    for rank, (state, paid) in enumerate(live):
        at, before = state, ""
        for inserted in range(3):
            ways = [("D", at, DELETE)]
            if not faulty:
                if letter == "s" and at == START:
                    ways.append(("K", SYSTEM, KEEP))
                if letter == _ROLE[_TURN[at]][0]:
                    ways.append(("K", _TURN[at], KEEP))
                ways.append(("R", _TURN[at], RENAME))
            for edit, to, price in ways:
                price += paid + INSERT * inserted + (CUT if cut and edit != "D" else 0)
                found = (price, rank, "I" * inserted + edit, state, before + ("\n" if edit != "D" and at != START else ""))
                best[to] = min(best.get(to, found), found)
            before += ("\n" if at != START else "") + _ROLE[_TURN[at]] + ":"
            at = _TURN[at]
    for state in _beaten({s: b[0] for s, b in best.items()}):
        del best[state]
    least = min(b[0] for b in best.values())
    order = sorted(best, key=lambda s: best[s][1:3])
    back = bytearray(4)
    for to, (_, _, edits, state, _) in best.items():
        back[to] = state | len(edits) - 1 << 2 | _LETTERS.index(edits[-1]) << 4
    moves = tuple((to, b[3], b[4].encode(), b[2][-1]) for to, b in best.items())
    return tuple((s, best[s][0] - least) for s in order), least, bytes(back), moves


def _last(live: tuple) -> tuple[int, int, int]:
    """State, cost above the least and insertions of the end."""
    needed = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
    _, _, k, state = min((paid + INSERT * needed[s], rank, needed[s], s) for rank, (s, paid) in enumerate(live))
    return state, dict(live)[state] + INSERT * k, k


class _Conversation:
    """What is held of the conversation that the stream is in."""

    def __init__(self, key):
        self.key, self.live, self.back, self.block = key, ((START, 0),), bytearray(), 0
        self.seen = {START: hashlib.sha256()}
        self.count = dict.fromkeys(COUNTS, 0)
        self.before, self.least, self.turn, self.turns = None, None, None, 0

    def row(self, turn, role: str, text: str, again: bool) -> None:
        count = self.count
        filled = text.rstrip(_SPACE)
        fault = "blank" if not filled else "duplicate" if again else "truncated" if filled[-1] not in ".!?" else None
        if fault:
            count[fault] += 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            count["illegal"] += 1
        self.before = role[:1]
        if turn is not None and turn != self.turn:
            self.least, self.turn, self.turns = turn if self.turns == 0 else self.least, turn, self.turns + 1
        self.live, more, back, moves = step(self.live, role[:1] if role[:1] in "sua" else "", fault in ("blank", "duplicate"), fault == "truncated")
        count["cost"] += more
        self.back += back
        seen, body = {}, None
        for to, state, before, edit in moves:
            seen[to] = digest = self.seen[state].copy()
            digest.update(before)
            if edit != "D":
                body = body if body is not None else text.encode()
                digest.update((role if edit == "K" else _ROLE[to]).encode() + b":")
                digest.update(body)
        self.seen = seen

    def full(self) -> tuple:
        out = (self.key, self.block, bytes(self.back), *[None] * (len(COUNTS) + 3))
        self.back, self.block = bytearray(), self.block + 1
        return out

    def end(self) -> tuple:
        state, paid, k = _last(self.live)
        self.count["cost"] += paid
        if self.turns:
            self.count["gaps"] = self.turn - self.least + 1 - self.turns
        digest, at = self.seen[state], state
        for _ in range(k):
            digest.update((("\n" if at != START else "") + _ROLE[_TURN[at]] + ":").encode())
            at = _TURN[at]
        return (self.key, self.block, bytes(self.back), *self.count.values(), state, k, digest.hexdigest())


def _schema(kind: str, *fields: str) -> str:
    return ", ".join([f"conv {kind}", *fields])


def _emit(rows: list[tuple], key: pa.DataType, types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([key, *types])], names=["conv", *names])


_POINTERS = ["block", "back", *COUNTS, "state", "tail", "sha"]
_POINTER_TYPES = [pa.int32(), pa.binary(), *[pa.int64()] * len(COUNTS), pa.int32(), pa.int32(), pa.string()]


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now = None
    for batch in batches:
        out, key = [], batch.schema.types[0]
        for conv, turn, role, text, again, present in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or now.key != conv:
                if now:
                    out.append(now.end())
                now = _Conversation(conv)
            if present:
                now.row(turn, role, text, again)
                if len(now.back) >= 4 * BLOCK:
                    out.append(now.full())
        if out:
            yield _emit(out, key, _POINTER_TYPES, _POINTERS)
    if now:
        yield _emit([now.end()], key, _POINTER_TYPES, _POINTERS)


def traced(back: bytes, state: int, tail: int = 0) -> tuple[str, int]:
    """Edits of a block of rows that ends in a state, with tail insertions after it; and the state before it."""
    edits = ["I" * tail]
    for at in range(len(back) - 4, -1, -4):
        code = back[at + state]
        edits.append("I" * (code >> 2 & 3) + _LETTERS[code >> 4])
        state = code & 3
    return "".join(reversed(edits)), state


def _backward(whole: bool):
    """Blocks of back-pointers, last block first, to (conversation, counts, edits, digest), or to the edits of each block."""
    types = [*[pa.int64()] * len(COUNTS), pa.string(), pa.string()] if whole else [pa.int64(), pa.int32(), pa.string()]
    names = [*COUNTS, "audit", "sha"] if whole else ["at", "state", "edits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, parts = None, START, []
        for batch in batches:
            out, key = [], batch.schema.types[0]
            for d in zip(*(c.to_pylist() for c in batch.columns)):
                conv, block, back, counts, (end, tail, sha) = d[0], d[1], d[2], d[3:-3], d[-3:]
                if end is not None:
                    if now:
                        out.append((*now[:-1], "".join(reversed(parts)), now[-1]))
                    now, parts, state = (conv, *counts, sha) if whole else None, [], end
                edits, state = traced(back, state, tail or 0)
                if whole:
                    parts.append(edits)
                else:
                    out.append((conv, block * BLOCK, state, edits))
            if out:
                yield _emit(out, key, types, names)
        if now:
            yield _emit([(*now[:-1], "".join(reversed(parts)), now[-1])], key, types, names)

    return run


def _ready(rows: DataFrame, conv: str, turn: str, role: str, text: str, present: Column | None) -> DataFrame:
    """(conv, turn, role, text, again, present) in order within partitions by conversation; again: the role and text came before."""
    one = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(" "))
    here = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    named = rows.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), one(role).alias("role"), one(text).alias("text"), here.alias("present"))
    dealt = named.repartition(partitions_for(named), "conv").withColumn("_same", F.sha2(F.concat_ws("\n", "role", "text"), 256))
    # Dealt by the conversation already: this window sorts, and shuffles nothing.
    order = [F.asc_nulls_first("turn"), "role", "text"]
    again = F.row_number().over(Window.partitionBy("conv", "_same", F.length("role"), "present").orderBy(*order)) > 1
    return dealt.withColumn("again", again).select("conv", "turn", "role", "text", "again", "present").sortWithinPartitions("conv", *order)


def _pointers(ready: DataFrame) -> DataFrame:
    kind = ready.schema["conv"].dataType.simpleString()
    fields = ["block int", "back binary", *[f"{c} long" for c in COUNTS], "state int", "tail int", "sha string"]
    return arrow_map(ready, _forward, _schema(kind, *fields)).sortWithinPartitions("conv", F.desc("block"))


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit (the edits) and repaired_sha256.

    present: rows for which it doesn't hold only name their conversation.
    """
    ready = _ready(rows, conv, turn, role, text, present)
    kind = ready.schema["conv"].dataType.simpleString()
    found = arrow_map(_pointers(ready), _backward(True), _schema(kind, *[f"{c} long" for c in COUNTS], "audit string", "sha string"))
    return found.select(F.col("conv").alias(conv), *COUNTS, "audit", F.col("sha").alias("repaired_sha256"))


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and, in front of each BLOCK of them, their edits, to the rows of the repaired conversations."""
    edits, at, state, number = "", 0, START, 0
    for batch in batches:
        out, key = [], batch.schema.types[0]
        for conv, place, kind, turn, role, text, begin, block in zip(*(c.to_pylist() for c in batch.columns)):
            if kind == 0:
                edits, at, state = block, 0, begin
                number = 0 if place == 0 else number
            while at < len(edits):
                edit = edits[at]
                if edit != "I" and kind == 0:
                    break
                at += 1
                if edit == "D":
                    break
                if edit == "K" and role[:1] == "s":
                    state = SYSTEM
                else:
                    state = _TURN[state]
                out.append((conv, number, None if edit == "I" else turn, role if edit == "K" else _ROLE[state], "" if edit == "I" else text, edit))
                number += 1
                if edit != "I":
                    break
            # Insertions after a row go out with it, as nothing may follow.
            while kind and at < len(edits) and edits[at] == "I":
                at, state = at + 1, _TURN[state]
                out.append((conv, number, None, _ROLE[state], "", "I"))
                number += 1
        if out:
            yield _emit(out, key, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()], ["number", "turn", "role", "text", "edit"])


def repaired(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """The rows of the repaired conversations: conversation, number from 0, turn (null if inserted), role, text and edit (K, R, I)."""
    ready = _ready(rows, conv, turn, role, text, present)
    kind = ready.schema["conv"].dataType.simpleString()
    order = [F.asc_nulls_first("turn"), "role", "text"]
    mine = ready.where("present").withColumn("at", F.row_number().over(Window.partitionBy("conv").orderBy(*order)).cast("long") - 1)
    blocks = arrow_map(_pointers(ready), _backward(False), _schema(kind, "at long", "state int", "edits string"))
    null = lambda t: F.lit(None).cast(t)
    both = mine.select("conv", "at", F.lit(1).alias("kind"), "turn", "role", "text", null("int").alias("state"), null("string").alias("edits")).unionByName(
        blocks.select("conv", "at", F.lit(0).alias("kind"), null("long").alias("turn"), null("string").alias("role"), null("string").alias("text"), "state", "edits")
    )
    dealt = both.repartition(partitions_for(rows, text), "conv").sortWithinPartitions("conv", "at", "kind")
    out = arrow_map(dealt, _apply, _schema(kind, "number long", "turn long", "role string", "text string", "edit string"))
    return out.select(F.col("conv").alias(conv), "number", F.col("turn").alias(turn), F.col("role").alias(role), F.col("text").alias(text), "edit")


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, present) with the damage of a test: by a checksum of id and turn a row is dropped (kept, but
    absent), emptied, loses its stops, stands twice, or becomes the user's."""
    one = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    code = F.pmod(F.crc32(F.concat_ws(":", one(conv), one(turn))), F.lit(20))
    said = F.when(code == 1, "").when(code == 2, F.regexp_replace(one(text), "[.!?]", "")).otherwise(one(text))
    out = rows.select(
        F.col(f"`{conv}`").alias(conv), F.col(f"`{turn}`").alias(turn), F.when(code == 4, "user").otherwise(one(role)).alias(role), said.alias(text),
        (code != 0).alias("present"), F.explode(F.array_repeat(F.lit(0), F.when(code == 3, 2).otherwise(1))).alias("_copy"),
    )
    return out.drop("_copy")


def op11_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and digest of the repaired conversation, for every conversation after damage."""
    return repair(damaged(read(spark, sf_dir, "conversations")), present=F.col("present"))
