"""Structure repair of conversations: a generalised LR parse of the roles whose errors are mended at the least cost.

The role grammar (``s`` system, ``u`` user, ``a`` assistant) becomes a table of shift
and reduce actions. A conversation is read turn by turn by a graph-structured stack: a
node is a parser state and the node below it, nodes are shared, and all stacks live
side by side. Between turns an *insert* may shift a user or assistant turn without text;
a turn may be *kept* (shift its own role), *reroled* (shift another) or *deleted* (no
shift). Stacks that come out equal merge to the least (cost, audit), the audit being the
edits' initials, so that ties go to the ASCII-least audit of all. (Of two audits that
reach the same stack at the same cost over the same turns, neither begins the other, as
the rest would be inserts, which cost; so the least audit stays least when it goes on.)

What all live stacks' audits begin with is decided: it is carried out and forgotten, as
are the turns it covers. So a task holds a few open turns of one conversation at a time,
however long that is, and steps are looked up by (turn's role and faults, open stacks).

*Size.* Faults are found in DataFrame operations. Conversations are dealt by their id; a
conversation's turns stream through one task in order (a digest over them has to), sorted
by Spark with spilling, and nothing of it is collected.

Defined results: null roles and texts are one space; rows of a turn number stand by role
and text; null turns come first; null ids are an id; of repeated rows all but the first are
duplicates; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .shared import table

#: Nonterminals are upper case. A conversation is empty, or pairs of turns behind at most one system turn.
GRAMMAR = (("T", "C"), ("C", ""), ("C", "P"), ("C", "sP"), ("P", "ua"), ("P", "Pua"))
NAMES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 3, 4, 3, 3
BLANK, DUPLICATE, TRUNCATED, SOUND = "blank", "duplicate", "truncated", ""

State = int
Stack = tuple  # (state, the stack below) or ()
#: Live stacks with their cost and open audit, in a fixed order.
Live = tuple


class Table:
    """Shift, goto and reduce actions of a grammar (SLR)."""

    def __init__(self, rules: tuple[tuple[str, str], ...]):
        self.rules = rules
        first, follow = self._sets()
        start = self._closure({(0, 0)})
        states, self.step, self.reduce = [start], {}, []
        for i, items in enumerate(states):  # grows while it is read
            for x in {rules[r][1][d] for r, d in items if d < len(rules[r][1])}:
                moved = self._closure({(r, d + 1) for r, d in items if rules[r][1][d : d + 1] == x})
                if moved not in states:
                    states.append(moved)
                self.step[i, x] = states.index(moved)
            self.reduce.append([(r, follow[rules[r][0]]) for r, d in sorted(items) if d == len(rules[r][1])])

    def _closure(self, items: set) -> frozenset:
        while True:
            heads = {self.rules[r][1][d] for r, d in items if d < len(self.rules[r][1])}
            more = items | {(r, 0) for r, (head, _) in enumerate(self.rules) if head in heads}
            if more == items:
                return frozenset(items)
            items = more

    def _sets(self) -> tuple[dict, dict]:
        heads = {h for h, _ in self.rules}
        first = {h: set() for h in heads}
        follow = {h: set() for h in heads} | {self.rules[0][0]: {"$"}}

        def first_of(body: str) -> set:
            out = set()
            for x in body:
                found = first[x] if x in heads else {x}
                out |= found - {""}
                if "" not in found:
                    return out
            return out | {""}

        while True:
            before = sum(map(len, (*first.values(), *follow.values())))
            for head, body in self.rules:
                first[head] |= first_of(body)
                for i, x in enumerate(body):
                    if x in heads:
                        rest = first_of(body[i + 1 :])
                        follow[x] |= rest - {""} | (follow[head] if "" in rest else set())
            if sum(map(len, (*first.values(), *follow.values()))) == before:
                return first, follow


TABLE = Table(GRAMMAR)
BOTTOM: Stack = (0, ())


@lru_cache(None)
def shifted(stack: Stack, symbol: str) -> tuple[Stack, ...]:
    """The stacks after all reductions that ``symbol`` allows and its shift; for ``$`` the stacks that accept."""
    out, open_, seen = [], [stack], {stack}
    while open_:
        top = open_.pop()
        state = top[0]
        if symbol != "$" and (state, symbol) in TABLE.step:
            out.append((TABLE.step[state, symbol], top))
        for rule, after in TABLE.reduce[state]:
            head, body = TABLE.rules[rule]
            if symbol not in after:
                continue
            if rule == 0:
                out.append(top)
                continue
            below = top
            for _ in body:
                below = below[1]
            reduced = (TABLE.step[below[0], head], below)
            if reduced not in seen:
                seen.add(reduced)
                open_.append(reduced)
    return tuple(sorted(set(out)))


def _merge(into: dict, stack: Stack, cost: int, audit: str) -> bool:
    if stack in into and into[stack] <= (cost, audit):
        return False
    into[stack] = (cost, audit)
    return True


def _with_inserts(live: dict) -> dict:
    out, open_ = dict(live), list(live)
    while open_:
        stack = open_.pop(0)
        cost, audit = out[stack]
        for symbol in NAMES:
            open_ += [s for s in shifted(stack, symbol) if _merge(out, s, cost + INSERT, audit + "I")]
    return out


@lru_cache(1 << 16)
def step(live: Live, initial: str, fault: str) -> tuple[int, str, Live]:
    """One turn further: the cost and the audit that all live stacks share from now on, and the stacks with the rest."""
    out: dict = {}
    for stack, (cost, audit) in _with_inserts(dict(live)).items():
        _merge(out, stack, cost + DELETE, audit + "D")
        if fault in (BLANK, DUPLICATE):
            continue
        more = UNFINISHED if fault == TRUNCATED else 0
        for s in shifted(stack, initial):
            _merge(out, s, cost + KEEP + more, audit + "K")
        for symbol in NAMES:
            for s in shifted(stack, symbol):
                _merge(out, s, cost + REROLE + more, audit + "R")
    least = min(c for c, _ in out.values())
    common = os.path.commonprefix([a for _, a in out.values()])
    return least, common, tuple(sorted((s, (c - least, a[len(common) :])) for s, (c, a) in out.items()))


class Repair:
    """The open parse of one conversation. ``turn`` and ``finish`` return the turns decided: (edit, role, text)."""

    def __init__(self):
        self.live: Live = ((BOTTOM, (0, "")),)
        self.cost, self.audit = 0, []
        self.at: Stack = BOTTOM
        self.open: deque = deque()

    def turn(self, role: str, text: str, fault: str) -> list[tuple[str, str, str]]:
        self.open.append((role, text))
        initial = role[:1] if role[:1] in ("s", "u", "a") else "?"
        cost, audit, self.live = step(self.live, initial, fault)
        self.cost += cost
        return self._carry_out(audit)

    def finish(self) -> list[tuple[str, str, str]]:
        done = {s: best for s, best in _with_inserts(dict(self.live)).items() if shifted(s, "$")}
        cost, audit = min(done.values())
        self.cost += cost
        return self._carry_out(audit)

    def _carry_out(self, audit: str) -> list[tuple[str, str, str]]:
        out = []
        self.audit.append(audit)
        for edit in audit:
            role, text = ("", "") if edit == "I" else self.open.popleft()
            if edit in "IR":  # the grammar leaves one choice
                symbol = next(x for x in NAMES if shifted(self.at, x))
                role = NAMES[symbol]
            else:
                symbol = role[:1]
            if edit != "D":
                self.at = shifted(self.at, symbol)[0]
            out.append((edit, role, text))
        return out


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage by a hash of id and turn; a dropped row stays with ``present`` false, so that its conversation is known."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")), F.lit(20))
    lean = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), one("role").alias("role"), one("text").alias("text"), kind.alias("kind"))
    k = F.col("kind")
    return lean.select(
        "conv_id", "turn", F.when(k == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(k <= 1, F.lit("")).when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"), (k != 0).alias("present"),
        F.explode(F.when(k == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")
    ).drop("copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """Rows dealt by conversation and in order, each with its first fault.

    All that a row's own text tells is found before the rows are dealt, so that the task of a
    very long conversation only puts its rows in order and goes through them.
    """
    space = r"[\x20\x09-\x0D]"
    own = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(BLANK)).when(~F.col("text").rlike(rf"[.!?]{space}*\z"), F.lit(TRUNCATED)).otherwise(F.lit(SOUND))
    dealt = rows.withColumn("own", own).withColumn("digest", F.unhex(F.sha2("text", 256))).repartition("conv_id")
    seen = Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("present").desc(), F.col("turn").asc_nulls_first())
    out = dealt.withColumn("again", F.row_number().over(seen) > 1)
    fault = F.when(F.col("again") & (F.col("own") != BLANK), F.lit(DUPLICATE)).otherwise(F.col("own"))
    out = out.select("conv_id", "turn", "role", "text", "present", fault.alias("fault"), "again")
    return out.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "again").drop("again")


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "present", "fault")))


class Summary:
    """Counts of one conversation as it streams by, and the digest of its repaired turns."""

    def __init__(self):
        self.repair, self.sha, self.began = Repair(), hashlib.sha256(), False
        self.n = dict.fromkeys((BLANK, DUPLICATE, TRUNCATED, SOUND), 0)
        self.least = self.last_turn = self.last = None
        self.distinct = self.illegal = 0

    def take(self, turn: int | None, role: str, text: str, fault: str) -> list[tuple[str, str, str]]:
        self.n[fault] += 1
        if turn is not None and turn != self.last_turn:
            self.distinct += 1
            self.least = turn if self.least is None else self.least
            self.last_turn = turn
        self.illegal += self.last is not None and self.last + role[:1] not in ("su", "ua", "au")
        self.last = role[:1]
        return self.hashed(self.repair.turn(role, text, fault))

    def hashed(self, done: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
        for edit, role, text in done:
            if edit != "D":
                self.sha.update(f"{chr(10) if self.began else ''}{role}:{text}".encode())
                self.began = True
        return done

    def row(self) -> tuple:
        gaps = 0 if self.least is None else self.last_turn - self.least + 1 - self.distinct
        r = self.repair
        return gaps, self.n[BLANK], self.n[DUPLICATE], self.n[TRUNCATED], self.illegal, r.cost, "".join(r.audit), self.sha.hexdigest()


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Summary, list, bool]]:
    """(id, summary, turns decided, whether it is at its end), for each turn and each end."""
    now, at = None, None
    for conv, turn, role, text, present, fault in _turns(batches):
        if now is None or conv != at:
            if now is not None:
                yield at, now, now.hashed(now.repair.finish()), True
            now, at = Summary(), conv
        if present:
            yield at, now, now.take(turn, role, text, fault), False
    if now is not None:
        yield at, now, now.hashed(now.repair.finish()), True


def _written(rows: Iterator[tuple], schema: pa.Schema, most_rows: int = 2000, most_chars: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for r in rows:
        held.append(r)
        chars += sum(len(x) for x in r if isinstance(x, str))
        if len(held) >= most_rows or chars >= most_chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _over(rows: DataFrame, columns: str, made) -> DataFrame:
    """``made`` over whole conversations; the id keeps its type."""
    out = T.StructType([rows.schema["conv_id"], *T.StructType.fromDDL(columns).fields])
    schema = to_arrow_schema(out)
    return with_faults(rows).mapInArrow(lambda batches: _written(made(_conversations(batches)), schema), out)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, place, edit, role, text), deleted turns among them with edit ``D``."""

    def made(found: Iterator) -> Iterator[tuple]:
        place = 0
        for conv, _, done, ends in found:
            for d in done:
                yield (conv, place, *d)
                place += 1
            place = 0 if ends else place

    return _over(rows, "place long, edit string, role string, text string", made)


def repair_report(rows: DataFrame) -> DataFrame:
    """Per conversation its faults, the cost and audit of its repair, and the digest of the repaired turns."""

    def made(found: Iterator) -> Iterator[tuple]:
        return ((conv, *now.row()) for conv, now, _, ends in found if ends)

    counts = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
    return _over(rows, f"{counts}, audit string, repaired_sha256 string", made)


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(damaged(table(spark, sf_dir, "conversations")))
