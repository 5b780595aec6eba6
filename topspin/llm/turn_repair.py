"""Repair of the turn structure of conversations by a rank-compressed dynamic program (operator 11).

A repaired conversation has roles ``(system? (user assistant)+)?``. An edit script has a letter for each edit: ``D`` delete, ``I`` insert, ``K``
keep, ``R`` rerole. It is cut into *macro edits*, each a run of inserts and the edit of one turn, coded as ``I...I`` and that edit's letter. No
code begins another, so scripts for equally many turns compare like the sequences of their codes.

The program has a layer for each turn and a state for each place in the role pattern. A state holds its cost and, in place of its
script, that script's rank among those of its layer: the next layer's scripts compare by ``(rank before, code)``. Each layer leaves pointers (state
before, code); from the cheapest last state, ties to the least script, they give the script. Costs relative to a layer's least and
ranks take few values, so layers are looked up in a cache.

Turns are dealt out by ranges of ``(conversation, turn, role, text)``, so even a conversation with most of all turns is spread over tasks. One
that lies within a task is repaired there. What crosses a border of tasks goes on by itself: copies are counted, first occurrences found by
aggregation, and a stream of short rows gives the script. Its edits are applied to a stream of its turns. There a task takes all of a
conversation, as its script and its digest are sequential, but holds no more than the script and pointers of eight bytes a turn, never the texts.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from topspin.llm.shared import materialise

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
_ENDS = re.compile(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z")
#: States of the role pattern: nothing yet, a system turn, a user turn, an assistant turn (all of which the others follow). The first and last may end it.
START, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (START, ASSISTANT)
NAMES = {USER: "user", ASSISTANT: "assistant"}
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_KEPT = {(START, "s"): SYSTEM} | {(s, "u"): USER for s in (START, SYSTEM, ASSISTANT)} | {(USER, "a"): ASSISTANT}
#: Two inserts in a row come back to the state before or to where a deletion leads for less; more can't be of use.
RUNS = range(3)
CODES = sorted("I" * k + edit for k in RUNS for edit in "DKR")


def _insert(state: int, count: int) -> int:
    for _ in range(count):
        state = _NEXT[state]
    return state


@lru_cache(maxsize=None)
def _moves(initial: str, must_go: bool, truncated: bool) -> tuple[tuple[int, int, int, int], ...]:
    """``(state before, state after, cost, code)`` of every macro edit of such a turn."""
    found = []
    for before, k in itertools.product(range(4), RUNS):
        state, code = _insert(before, k), "I" * k
        found.append((before, state, INSERT * k + DELETE, CODES.index(code + "D")))
        if not must_go:
            extra = INSERT * k + TRUNCATED * truncated
            if (state, initial) in _KEPT:
                found.append((before, _KEPT[state, initial], extra, CODES.index(code + "K")))
            found.append((before, _NEXT[state], extra + REROLE, CODES.index(code + "R")))
    return tuple(found)


@lru_cache(maxsize=1 << 16)
def _layer(costs: tuple, ranks: tuple, initial: str, must_go: bool, truncated: bool) -> tuple[int, tuple, tuple, tuple]:
    """The next layer: what its least cost adds, costs above that (None: not reached), ranks, and pointers ``(state before, code)``."""
    best: dict[int, tuple] = {}
    for before, after, cost, code in _moves(initial, must_go, truncated):
        if costs[before] is not None:
            way = (costs[before] + cost, ranks[before], code, before)
            if after not in best or way < best[after]:
                best[after] = way
    least = min(way[0] for way in best.values())
    order = {key: i for i, key in enumerate(sorted({way[1:3] for way in best.values()}))}
    at = [best.get(s) for s in range(4)]
    return least, tuple(w and w[0] - least for w in at), tuple(w and order[w[1:3]] for w in at), tuple(w and (w[3], w[2]) for w in at)


def script(turns: Iterator[tuple[str, bool, bool]]) -> tuple[int, str]:
    """Cost and edit script for turns ``(role's initial, must be deleted, truncated)``."""
    total, costs, ranks, pointers = 0, (0, None, None, None), (0, None, None, None), []
    for initial, must_go, truncated in turns:
        more, costs, ranks, back = _layer(costs, ranks, initial if initial in ("s", "u", "a") else "", must_go, truncated)
        total += more
        pointers.append(back)
    cost, _, k, state = min((costs[s] + INSERT * k, ranks[s], k, s) for s in range(4) for k in RUNS if costs[s] is not None and _insert(s, k) in FINAL)
    codes = ["I" * k]
    for back in reversed(pointers):
        state, code = back[state]
        codes.append(CODES[code])
    return total + cost, "".join(reversed(codes))


def repaired(edits: Iterator[str], turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The turns ``(role, text)`` that a script leaves."""
    state, turns = START, iter(turns)
    for edit in edits:
        if edit == "I":
            state = _NEXT[state]
            yield NAMES[state], ""
            continue
        role, text = next(turns)
        if edit == "K":
            state = _KEPT[state, role[0]]
            yield role, text
        elif edit == "R":
            state = _NEXT[state]
            yield NAMES[state], text


def _fault(text: str) -> str:
    end = _ENDS.search(text)
    return "blank" if not end else "" if end[1] in ".!?" else "truncated"


class _Summary:
    """What is told of a conversation; ``facts`` feeds the program while it counts."""

    def __init__(self) -> None:
        self.counts = dict.fromkeys(("", "blank", "duplicate", "truncated"), 0)
        self.first = self.last = self.before = None
        self.numbers = self.illegal = 0

    def fact(self, turn: int | None, initial: str, fault: str, seen: bool) -> tuple[str, bool, bool]:
        if turn is not None:
            self.numbers += turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn
        fault = "duplicate" if seen and fault != "blank" else fault
        self.counts[fault] += 1
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        return initial, fault in ("blank", "duplicate"), fault == "truncated"

    def row(self, conv: object, cost: int, audit: str) -> dict:
        gaps = self.last - self.first + 1 - self.numbers if self.numbers else 0
        faults = {k: n for k, n in self.counts.items() if k}
        return {"conv": conv, "turns": sum(self.counts.values()), "gaps": gaps} | faults | {"illegal": self.illegal, "cost": cost, "audit": audit}


_FACTS = "turns long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _conversations(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[object, Iterator[tuple]]]:
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("conv", *columns)), strict=True))
    return itertools.groupby(rows, key=lambda row: row[0])


def _batched(rows: Iterator[dict], schema: pa.Schema, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + sum(len(v) for v in row.values() if isinstance(v, str))
        if size > limit:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _within(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sorted turns of a task: scripts of the conversations that lie within it, and the turns of its first and last one, which may not."""

    def summary(conv: object, turns: list[tuple]) -> dict:
        told, seen, facts = _Summary(), set(), []
        for _, turn, role, text in turns:
            facts.append(told.fact(turn, role[:1], _fault(text), (role, text) in seen))
            seen.add((role, text))
        return told.row(conv, *script(facts))

    def rows() -> Iterator[dict]:
        held, number = None, 0
        for number, (conv, group) in enumerate(_conversations(batches, "turn", "role", "text")):  # noqa: B007
            if held is not None and number > 1:
                yield summary(*held)
                held = None
            group = ({"conv": conv, "turn": t, "role": r, "text": x} for _, t, r, x in group) if number == 0 else list(group)
            if number == 0:
                yield from group
            else:
                held = conv, group
        if held is not None:
            yield from ({"conv": c, "turn": t, "role": r, "text": x} for c, t, r, x in held[1])

    return _batched(rows(), schema)


def _scripts(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Short rows of conversations, sorted: their scripts."""

    def rows() -> Iterator[dict]:
        for conv, group in _conversations(batches, "turn", "initial", "fault", "seen", "copies"):
            told = _Summary()
            facts = (told.fact(turn, initial, fault, seen or copy > 0) for _, turn, initial, fault, seen, copies in group for copy in range(copies))
            yield told.row(conv, *script(facts))

    return _batched(rows(), schema)


def _across(rows: DataFrame, ddl: str) -> DataFrame:
    """Scripts of conversations whose turns ``(conv, turn, role, text)`` lie in several tasks."""
    place = F.row_number().over(Window.partitionBy("conv", "turn").orderBy("role", "text"))
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies")).withColumn("place", place)
    same = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"))
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank").when(F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "").otherwise("truncated")
    short = materialise(rows.select("conv", "turn", "place", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), same.alias("same"), "copies"))
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = short.groupBy(F.col("conv").alias("c"), F.col("same").alias("s")).agg(F.min(when).alias("first"))
    short = short.join(first, F.col("c").eqNullSafe(F.col("conv")) & (F.col("s") == F.col("same"))).withColumn("seen", F.col("first") < when)
    short = short.select("conv", "turn", "place", "initial", "fault", "seen", "copies").repartition("conv").sortWithinPartitions("conv", "turn", "place")
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))
    return short.mapInArrow(lambda b: _scripts(b, schema), ddl)


def _turns(turns: DataFrame, id_column: str, turn_column: str, role_column: str, text_column: str) -> DataFrame:
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return turns.select(F.col(id_column).alias("conv"), F.col(turn_column).cast("long").alias("turn"), said(role_column).alias("role"), said(text_column).alias("text"))


def repair_scripts(turns: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """``(id_column, turns, gaps, blank, duplicate, truncated, illegal, cost, audit)``: one row for each conversation of ``turns``.

    Turns stand by their number, nulls first, then by role and text. ``gaps`` are numbers missing between the least and the greatest. Each turn's first
    fault counts: ``blank`` (no other than ASCII white space), ``duplicate`` (an earlier turn has its role and text), ``truncated`` (the last character that is no white
    space isn't one of ``.!?``). ``illegal`` counts neighbours whose roles don't follow each other. ``audit`` is the cheapest edit script
    (the least of several), see the module: a blank or duplicate turn has to go; keeping or rerolling a truncated one costs 5 more. A null role or
    text counts as one space, a null id is a conversation's as any other. Repeated rows are duplicates. Other columns are left out.
    """
    rows = _turns(turns, id_column, turn_column, role_column, text_column)
    ddl = f"conv {rows.schema['conv'].dataType.simpleString()}, {_FACTS}"
    # by the text's first characters, so that the sample of keys stays small
    rows = rows.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv", "turn", "role", "text")
    both = f"{ddl}, turn long, role string, text string"
    schema = to_arrow_schema(T.StructType.fromDDL(both))
    found = materialise(rows.mapInArrow(lambda b: _within(b, schema), both))
    done = found.where(F.col("audit").isNotNull()).drop("turn", "role", "text")
    return done.unionByName(_across(found.where(F.col("audit").isNull()).select("conv", "turn", "role", "text"), ddl)).withColumnRenamed("conv", id_column)


def repaired_turns(turns: DataFrame, scripts: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """``(id_column, place, role, text)``: what the scripts of ``repair_scripts`` make of ``turns``.

    The turns of a conversation are numbered from 0 and stand together in a task, in their order.
    """
    rows = _turns(turns, id_column, turn_column, role_column, text_column)
    heads = scripts.select(F.col(id_column).alias("conv"), F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), "audit")
    rows = heads.unionByName(rows.select("conv", F.lit(1).alias("part"), "turn", "role", "text", F.lit(None).cast("string").alias("audit")))
    rows = rows.repartition("conv").sortWithinPartitions("conv", "part", "turn", "role", "text")
    ddl = f"conv {rows.schema['conv'].dataType.simpleString()}, place long, role string, text string"
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def left() -> Iterator[dict]:
            for conv, group in _conversations(batches, "role", "text", "audit"):
                audit = next(group)[3]
                for place, (role, text) in enumerate(repaired(audit, (row[1:3] for row in group))):
                    yield {"conv": conv, "place": place, "role": role, "text": text}

        return _batched(left(), schema)

    return rows.mapInArrow(run, ddl).withColumnRenamed("conv", id_column)


def digests(repaired_rows: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """``(id_column, sha256)`` of the ``role:text`` lines, joined by line feeds, of conversations that stand as ``repaired_turns`` gives them. One without turns has no row."""
    ddl = f"conv {repaired_rows.schema[id_column].dataType.simpleString()}, sha256 string"
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hashed() -> Iterator[dict]:
            for conv, group in _conversations(batches, "role", "text"):
                digest = hashlib.sha256()
                for i, (_, role, text) in enumerate(group):
                    digest.update(f"{chr(10) * (i > 0)}{role}:{text}".encode("utf-8", "replace"))
                yield {"conv": conv, "sha256": digest.hexdigest()}

        return _batched(hashed(), schema)

    return repaired_rows.select(F.col(id_column).alias("conv"), "role", "text").mapInArrow(run, ddl).withColumnRenamed("conv", id_column)
