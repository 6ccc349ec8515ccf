"""Conversation structure repair: the cheapest edits that make a conversation alternate, by secondary-sorted streams.

Rows are dealt by conversation and sorted by turn. One stream runs through each conversation from its last row to its first and carries the
cost of finishing from each state of the pattern; its backpointers, one byte a row, leave the task in blocks, as rows of a table in the
shared folder. A second stream meets every block just before the rows it belongs to, follows the pointers from the first row on and
applies the edits. Neither keeps more of a conversation than one block, the edits' initials excepted, which are one cell of the result.

A repaired conversation is empty, or an optional first row whose role begins with ``s``, then user and assistant rows in turn, an
assistant last; a kept row counts by the first character of its role. Edits and costs: Keep 0, Rerole to user or assistant 1, Delete 2,
Insert an empty user or assistant row 5. Blank and repeated rows must go; a truncated row that stays costs 5 more. Of equally cheap
repairs, the one whose initials are least in ASCII order is taken.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquill.llm.common import written

BLANK, REPEATED, TRUNCATED = 1, 2, 3
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
LETTERS = "DIKR"
#: Pointers in a block.
BLOCK = 1 << 16
_LONG = 2**63 - 1

# States: nothing yet, a first s, a user row last, an assistant row last. The pattern goes on with EXPECTED, to NEXT.
START, SYSTEM, USER, ASSISTANT = range(4)
EXPECTED = ("user", "user", "assistant", "user")
NEXT = (USER, USER, ASSISTANT, USER)
#: Cost of ending in each state: what is missing is inserted.
AT_END = (0, 2 * INSERT, INSERT, 0)


@functools.cache
def _step(initial: str, must_go: bool, cut: bool, after: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
    """One row backwards: from the costs of finishing after it to its pointers (two bits a state) and the costs of finishing before it."""
    extra = CUT if cut else 0
    moves: list[dict[str, int]] = []
    for q in range(4):
        here = {"D": DELETE + after[q]}
        if not must_go:
            here["R"] = REROLE + extra + after[NEXT[q]]
            if initial == EXPECTED[q][0]:
                here["K"] = KEEP + extra + after[NEXT[q]]
            elif q == START and initial == "s":
                here["K"] = KEEP + extra + after[SYSTEM]
        moves.append(here)
    costs = [min(m.values()) for m in moves]
    for _ in range(2):  # two inserted rows in a place at most: three would come back to the same state
        costs = [min(c, INSERT + costs[NEXT[q]]) for q, c in enumerate(costs)]
    pointers = 0
    for q, here in enumerate(moves):
        here["I"] = INSERT + costs[NEXT[q]]
        pointers |= LETTERS.index(min(letter for letter, cost in here.items() if cost == costs[q])) << 2 * q
    return pointers, tuple(costs)


def facts(rows: DataFrame, conv: str, turn: str, role: str, text: str, present: Column | None = None) -> DataFrame:
    """conv, pos (0, 1, ... by turn, nulls first, then role and text), turn as text, role, text, initial, fault; absent rows have pos -1.

    Window and sort use the partitioning by conversation, so the rows are shuffled once."""
    from_row = rows.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"),
        (F.lit(True) if present is None else present).alias("present"),
    )
    blanked = from_row.withColumns({c: F.when(F.col("present"), F.col(c)).otherwise("") for c in ("role", "text")})
    dealt = blanked.repartition("conv")
    alike = Window.partitionBy("conv", "present", "role", "text").orderBy("turn")
    told = dealt.withColumn("copy", F.row_number().over(alike))
    in_order = Window.partitionBy("conv", "present").orderBy("turn", "role", "text", "copy")
    told = told.withColumn("pos", F.when(F.col("present"), F.row_number().over(in_order).cast("long") - 1).otherwise(F.lit(-1)))
    bare = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    fault = F.when(F.length(bare) == 0, BLANK).when(F.col("copy") > 1, REPEATED).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    return told.select("conv", "pos", F.col("turn").cast("string").alias("turn"), "role", "text", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


_PLAN = "key string, block long, pointers binary, blank long, duplicate long, truncated long, illegal long, cost long, gaps long"


def _pointers(turns: DataFrame) -> DataFrame:
    """Blocks of backpointers, and for each conversation a row of counts with block -1."""

    def backwards(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        key, open_, costs, block, counts, later, last, first, distinct = None, False, AT_END, bytearray(), [0, 0, 0, 0], None, None, None, 0

        def close() -> None:
            nonlocal block
            if block:
                out.append((key, number, bytes(reversed(block)), None, None, None, None, None, None))
            gaps = 0 if last is None else min(int(last) - int(first) + 1 - distinct, _LONG)
            out.append((key, -1, None, *counts[1:], counts[0], base + costs[START], gaps))
            block = bytearray()

        base = number = 0
        for batch in batches:
            for k, pos, turn, initial, fault in zip(*(batch[c].tolist() for c in ("key", "pos", "turn", "initial", "fault")), strict=True):
                if not open_ or k != key:
                    if open_:
                        close()
                    key, open_, costs, base, counts, later, last, first, distinct = k, True, AT_END, 0, [0, 0, 0, 0], None, None, None, 0
                if pos < 0:
                    continue
                if block and pos // BLOCK != number:
                    out.append((key, number, bytes(reversed(block)), None, None, None, None, None, None))
                    block = bytearray()
                number = pos // BLOCK
                pointers, costs = _step(initial, fault in (BLANK, REPEATED), fault == TRUNCATED, costs)
                block.append(pointers)
                low = min(costs)
                base, costs = base + low, tuple(c - low for c in costs)
                if fault:
                    counts[fault] += 1
                counts[0] += later is not None and initial + later not in ("su", "ua", "au")
                later = initial
                if turn is not None:
                    last, distinct, first = last or turn, distinct + (turn != first), turn
            if out:
                yield pd.DataFrame(out, columns=names)
                out = []
        if open_:
            close()
            yield pd.DataFrame(out, columns=names)

    names = [c.split(" ")[0] for c in _PLAN.split(", ")]
    slim = turns.select("conv", "pos", "turn", "initial", "fault").repartition("conv").sortWithinPartitions("conv", F.desc("pos"))
    return slim.select(F.col("conv").cast("string").alias("key"), "pos", "turn", "initial", "fault").mapInPandas(backwards, _PLAN)


def _followed(turns: DataFrame, kind: str, build, schema: str) -> DataFrame:
    """Every conversation's rows with their edits, handed to a new ``build(key, counts)``: its ``edit`` gets (letter, role, text) in order,
    ``end`` yields result rows; ``edit`` may yield them too."""
    plan = written(_pointers(turns), "repair-pointers")
    counted = [c.split(" ")[0] for c in _PLAN.split(", ")][3:]
    same = plan.withColumn("conv", F.col("key").cast(kind)).drop("key").withColumns({c: F.col(c).cast("string") for c in counted})
    rows = turns.filter("pos >= 0").select("conv", F.floor(F.col("pos") / BLOCK).alias("block"), "pos", "role", "text")
    both = same.unionByName(rows, allowMissingColumns=True).repartition("conv").sortWithinPartitions("conv", "block", F.col("pos").asc_nulls_first())
    columns = ["key", "block", "pos", "pointers", "role", "text", *counted]
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def forwards(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, state, pointers, out, at = None, START, b"", [], 0

        def finish() -> None:
            q = state
            while q in (SYSTEM, USER):
                out.extend(one.edit("I", EXPECTED[q], ""))
                q = NEXT[q]
            out.extend(one.end())

        for batch in batches:
            for key, block, _, found, role, text, *counts in batch[columns].itertuples(index=False, name=None):
                if block == -1:
                    if one is not None:
                        finish()
                    one, state = build(key, dict(zip(counted, map(int, counts), strict=True))), START
                elif found is not None:
                    pointers, at = found, 0
                else:
                    byte, at = pointers[at], at + 1
                    while (letter := LETTERS[byte >> 2 * state & 3]) == "I":
                        out.extend(one.edit("I", EXPECTED[state], ""))
                        state = NEXT[state]
                    if letter == "D":
                        out.extend(one.edit("D", role, text))
                    elif letter == "R":
                        out.extend(one.edit("R", EXPECTED[state], text))
                        state = NEXT[state]
                    else:
                        out.extend(one.edit("K", role, text))
                        state = SYSTEM if state == START and role[0] == "s" else NEXT[state]
                if len(out) >= 10_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        if one is not None:
            finish()
        if out:
            yield pd.DataFrame(out, columns=names)

    return both.select(F.col("conv").cast("string").alias("key"), *columns[1:]).mapInPandas(forwards, schema)


class _Rows:
    """Edits as rows."""

    def __init__(self, key: str | None, counts: dict[str, int]):
        self.key, self.step, self.place = key, 0, 0

    def edit(self, letter: str, role: str, text: str) -> list[tuple]:
        self.step, self.place = self.step + 1, self.place + (letter != "D")
        return [(self.key, self.step - 1, letter, None if letter == "D" else self.place - 1, role, text)]

    def end(self) -> list[tuple]:
        return []


class _Digest:
    """Edits as their initials and the hash of what they leave."""

    def __init__(self, key: str | None, counts: dict[str, int]):
        self.key, self.counts, self.audit, self.hash, self.any = key, counts, bytearray(), hashlib.sha256(), False

    def edit(self, letter: str, role: str, text: str) -> tuple:
        self.audit += letter.encode()
        if letter != "D":
            self.hash.update((("\n" if self.any else "") + role + ":" + text).encode())
            self.any = True
        return ()

    def end(self) -> list[tuple]:
        c = self.counts
        return [(self.key, c["gaps"], c["blank"], c["duplicate"], c["truncated"], c["illegal"], c["cost"], self.audit.decode(), self.hash.hexdigest())]


def _turns(rows: DataFrame, conv: str, turn: str, role: str, text: str, present: Column | None) -> tuple[DataFrame, str]:
    return written(facts(rows, conv, turn, role, text, present), "repair-turns"), rows.schema[conv].dataType.simpleString()


def repaired(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """All edits, in order: conv_id, step (from 0), edit (K, R, D or I), place in the repaired conversation (null for D), role and text.

    Rows are taken by turn, nulls first, then by role and text; a null role or text is one space, a null id is a conversation of its own.
    Equal rows, and rows of one turn, are rows of their own. Other columns are not read; an empty table gives an empty result.
    """
    turns, kind = _turns(rows, conv, turn, role, text, None)
    out = _followed(turns, kind, _Rows, "key string, step long, edit string, place long, role string, text string")
    return out.select(F.col("key").cast(kind).alias("conv_id"), "step", "edit", "place", "role", "text")


def report(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit (the edits' initials) and repaired_sha256
    (of ``role:text`` of all rows after the edits, joined by newlines).

    Same rules as :func:`repaired`. ``present``, a condition on ``rows``, marks the rows that exist; a conversation without any has
    zeros, no edits and the hash of the empty string. A turn range beyond a long gives the largest long as ``gaps``. A hash is a
    sequence, so a conversation runs through one task, at its text's length; memory stays at one block, whatever its length.
    """
    turns, kind = _turns(rows, conv, turn, role, text, present)
    out = _followed(turns, kind, _Digest, "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    return out.select(F.col("key").cast(kind).alias("conv_id"), *out.columns[1:])


def damaged(rows: DataFrame) -> DataFrame:
    """The conversations of the query, damaged by a hash of ``conv_id:turn``: a row is dropped (``present`` is false), emptied, loses its
    sentence ends, is repeated, or becomes the user's. Nulls count as one space."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    name = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(":") for c in ("conv_id", ":", "turn")])
    code = (F.crc32(name.cast("binary")) % 20).alias("code")
    marked = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), code)
    marked = marked.withColumn("text", F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    marked = marked.withColumn("role", F.when(F.col("code") == 4, "user").otherwise(F.col("role"))).withColumn("present", F.col("code") != 0)
    return marked.withColumn("again", F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("code", "again")
