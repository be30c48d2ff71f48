"""Repair the turn structure of conversations by the cheapest edits, found by depth-first branch and bound.

Turns must go: perhaps one system turn, then user and assistant in alternation, ending with the
assistant; nothing at all is right too. Each row is kept, given another role or deleted, and empty turns
are inserted anywhere. The search walks an explicit stack of prefixes. A suffix lower bound (the same
problem where a conversation may also end after its system turn) ends a prefix that cannot beat the incumbent's
cost, or its cost and audit; a table for each node, that is a row and a state of the
grammar, keeps the best prefix seen there and ends all others. What is left when the stack is empty is
proved to be the cheapest, and among the cheapest the least audit by code points.

Conversations are dealt by id, ordered by Spark's sort and read as a stream. A long one is searched in
chunks of ``CHUNK`` rows: up to four prefixes, one for each state at the end of a chunk, enter the next,
so the search grows with the number of rows. The result has one row for each conversation with its turns, so a
conversation's text must fit in a task; nothing else is collected.

Defined results: a null role or text is one blank; a null id is a conversation of its own; null
turns come first and do not count for gaps; rows of the same turn are ordered by role and text; a role that is
empty or begins with another letter than s, u or a cannot be kept; an empty table gives no rows. Only the four named columns are read,
so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import os.path
import sys
from collections.abc import Iterator
from math import inf

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

# Workers receive these functions themselves, so they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 128
CHANGE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
BLANKS = " \t\n\x0b\x0c\r"
LEGAL_PAIRS = frozenset({"su", "ua", "au"})
# States of the grammar: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
COMPLETE = (START, ASSISTANT)
KEEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = (USER, USER, ASSISTANT, USER)  # the turn that a state lacks
ROLE = {USER: "user", ASSISTANT: "assistant"}

Row = tuple[str, bool, int]  # initial of the role, whether it must go, what it costs if it stays
Prefix = tuple[int, int, str]  # state, cost, audit

TURNS = ArrayType(StructType([StructField("role", StringType()), StructField("text", StringType())]))
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def lower_bounds(rows: list[Row], ends: tuple[int, ...]) -> list[tuple[float, ...]]:
    """For each row and state: a cost that the rest of the rows has at least.

    A system turn counts as an assistant turn once it has been taken, so a
    conversation may end after it; no bound is too high.
    """
    complete, asking = SYSTEM in ends or ASSISTANT in ends, USER in ends
    answered = min(0 if complete else inf, INSERT if asking else inf)
    asked = min(0 if asking else inf, INSERT if complete else inf)
    nothing = min(0 if START in ends else inf, INSERT + asked)
    found = [(nothing, answered, asked, answered)]
    for initial, must_go, stays in reversed(rows):
        to_nothing, to_answered, to_asked = nothing, answered, asked
        nothing, answered, asked = DELETE + to_nothing, DELETE + to_answered, DELETE + to_asked
        if not must_go:
            as_user = stays + to_asked + (0 if initial == "u" else CHANGE)
            nothing = min(nothing, as_user, stays + to_answered if initial == "s" else inf)
            answered = min(answered, as_user)
            asked = min(asked, stays + to_answered + (0 if initial == "a" else CHANGE))
        nothing, answered, asked = (min(nothing, INSERT + asked), min(answered, INSERT + asked), min(asked, INSERT + answered))
        found.append((nothing, answered, asked, answered))
    return found[::-1]


def search(rows: list[Row], entering: list[Prefix], ends: tuple[int, ...]) -> tuple[int, int, str, int] | None:
    """The best way from one of the prefixes to one of the end states: state, cost, audit and the state it came from."""
    n, bounds = len(rows), lower_bounds(rows, ends)
    best: tuple[int, str] | None = None
    found = None
    seen: dict[tuple[int, int], tuple[int, str]] = {}

    def bound(i: int, state: int, cost: int) -> float:
        return cost + bounds[i][state]

    stack = sorted(((bound(0, state, cost), audit, 0, state, cost, state) for state, cost, audit in entering), reverse=True)
    while stack:
        least, audit, i, state, cost, origin = stack.pop()
        if least == inf or best and (least > best[0] or least == best[0] and audit > best[1][:len(audit)]):
            continue
        known = seen.get((i, state))
        if known is not None and known <= (cost, audit):
            continue
        seen[i, state] = (cost, audit)
        if i == n and state in ends and (best is None or (cost, audit) < best):
            best, found = (cost, audit), (state, cost, audit, origin)
        lacking = NEXT[state]
        children = [(i, lacking, cost + INSERT, "I")]
        if i < n:
            initial, must_go, stays = rows[i]
            children.append((i + 1, state, cost + DELETE, "D"))
            if not must_go:
                children.append((i + 1, lacking, cost + CHANGE + stays, "R"))
                kept = KEEPS.get((state, initial))
                if kept is not None:
                    children.append((i + 1, kept, cost + stays, "K"))
        stack += sorted(((bound(j, s, c), audit + edit, j, s, c, origin) for j, s, c, edit in children), reverse=True)
    return found


def edited(texts: list[tuple[str, str]], state: int, audit: str) -> list[tuple[str, str]]:
    """The turns that the edits make of rows, from a state of the grammar on."""
    turns, i = [], 0
    for edit in audit:
        if edit == "K":
            turns.append(texts[i])
            state = KEEPS[state, texts[i][0][:1]]
        elif edit != "D":
            state = NEXT[state]
            turns.append((ROLE[state], texts[i][1] if edit == "R" else ""))
        i += edit != "I"
    return turns


class _Conversation:
    """One conversation, read row by row."""

    def __init__(self, conv, chunk: int):
        self.conv, self.chunk = conv, chunk
        self.low = self.high = self.last_turn = self.last_initial = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.seen: set[bytes] = set()
        self.rows: list[Row] = []
        self.texts: list[tuple[str, str]] = []
        self.settled: list[str] = []  # what all entering audits begin with
        # An entering prefix: its cost, the rest of its audit, and its turns as a chain of chunks.
        self.entering: dict[int, tuple[int, str, tuple | None]] = {START: (0, "", None)}

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.last_turn or self.high is None
            self.high = self.last_turn = turn
        initial = role[:1]
        if self.last_initial is not None:
            self.illegal += self.last_initial + initial not in LEGAL_PAIRS
        self.last_initial = initial
        digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
        end = text.rstrip(BLANKS)[-1:]
        blank, duplicate = not end, digest in self.seen
        self.seen.add(digest)
        truncated = not blank and not duplicate and end not in ".!?"
        self.blank += blank
        self.duplicate += duplicate and not blank
        self.truncated += truncated
        if len(self.rows) == self.chunk:
            self._advance(range(4))
        self.rows.append((initial, blank or duplicate, CUT_OFF * truncated))
        self.texts.append((role, text))

    def _advance(self, ends, together: bool = False) -> None:
        prefixes = [(state, cost, audit) for state, (cost, audit, _) in self.entering.items()]
        after = {}
        for targets in ([tuple(ends)] if together else [(e,) for e in ends]):
            if found := search(self.rows, prefixes, targets):
                state, cost, audit, origin = found
                _, before, chain = self.entering[origin]
                after[state] = (cost, audit, (chain, edited(self.texts, origin, audit[len(before):])))
        common = os.path.commonprefix([audit for _, audit, _ in after.values()])
        self.settled.append(common)
        self.entering = {s: (cost, audit[len(common):], chain) for s, (cost, audit, chain) in after.items()}
        self.rows, self.texts = [], []

    def outcome(self) -> dict:
        self._advance(COMPLETE, together=True)
        (cost, audit, chain), = self.entering.values()
        chunks = []
        while chain:
            chain, turns = chain
            chunks.append(turns)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"conv": self.conv, "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated,
                "illegal": self.illegal, "cost": cost, "audit": "".join(self.settled) + audit,
                "turns": [{"role": role, "text": text} for turns in reversed(chunks) for role, text in turns]}


def _repaired(schema: pa.Schema, chunk: int):
    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None
        for batch in batches:
            done = []
            for conv, present, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if current is None or current.conv != conv:
                    if current is not None:
                        done.append(current.outcome())
                    current = _Conversation(conv, chunk)
                if present:
                    current.add(turn, role, text)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if current is not None:
            yield pa.RecordBatch.from_pylist([current.outcome()], schema)

    return repaired


def repair(rows: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           present: Column | None = None, chunk: int = CHUNK) -> DataFrame:
    """One row per conversation: its faults, the cost and the edits of the cheapest repair, and the repaired turns.

    Rows that are not ``present`` only name their conversation.
    """
    read = rows.select(
        F.col(id_col).alias("conv"), F.coalesce(present, F.lit(False)).alias("present") if present is not None else F.lit(True).alias("present"),
        F.col(turn_col).cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(name)
                                                      for c, name in ((role_col, "role"), (text_col, "text"))))
    in_order = read.repartition("conv").sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text")
    out = StructType([StructField("conv", read.schema["conv"].dataType), *(StructField(c, LongType()) for c in COUNTS),
                      StructField("audit", StringType()), StructField("turns", TURNS)])
    return in_order.mapInArrow(_repaired(to_arrow_schema(out), chunk), out).withColumnRenamed("conv", id_col)


def damage(rows: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """Drop, empty, cut, repeat or misname one row in twenty each, by the checksum of its id and turn.

    Dropped rows stay as rows that are not ``present``.
    """
    def named(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(named(id_col), F.lit(":"), named(turn_col))) % 20
    return rows.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(named(role_col)).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(named(text_col), ".!?", "")).otherwise(named(text_col)).alias("text"),
        (kind != 0).alias("present"), F.explode(F.array_repeat(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("copy"))


def as_text(turns: str) -> Column:
    """A conversation's turns as lines of role and text."""
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
