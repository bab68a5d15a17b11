"""Conversation structure repair: lightest derivations from an agenda."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postpulse.llm.common import in_tasks, named

RETITLE, DELETE, INSERT, CUT = 3, 4, 3, 3  # costs; CUT: for each truncated turn that stays
BLOCK = 512  # turns that wait for a decision before a first look at them
NAMES = {"u": "user", "a": "assistant"}

# Role initials read so far must begin (s?(ua)+)?: state -> next state by initial.
AFTER = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
WANTED = {s: next(i for i in reversed(to)) for s, to in AFTER.items()}  # user or assistant
ENDS = (0, 3)
# (s, t): how much more than from state s the rest of a repair can cost from state t. What may follow
# after a may follow at the start too; in place of a kept s a turn can be deleted; an Insert leads from
# u to a and back.
DEARER = {(0, 2): 7, (0, 3): 4, (1, 0): 0, (1, 2): 3, (1, 3): 0, (2, 0): 3, (2, 1): 3, (2, 3): 3,
          (3, 0): 0, (3, 2): 3}
SPACES = r"[\x20\x09-\x0D]"


def damage(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """Known damage for trials: crc32 of ``key:turn`` modulo 20 drops (0), empties (1), removes
    sentence ends (2), repeats (3) or retitles (4) a row. Nulls count as one space, in role and text
    for good. Output: conv_id, turn, role, text."""
    space = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(named(key)), F.lit(":"), space(named(turn))).cast("binary")) % 20
    body = space(named(text))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where(kind != 0).select(
        named(key).alias("conv_id"), named(turn).alias("turn"),
        F.when(kind == 4, "user").otherwise(space(named(role))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(body, "[.!?]", ""))
        .otherwise(body).alias("text"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


def agenda(front: dict[int, tuple[int, str]], turns: list[tuple], final: bool
           ) -> dict[int, tuple[int, str]]:
    """Lightest derivations of the items (all ``turns`` read, state), or with ``final`` of the goal.

    An item is (turns read, state); ``front`` gives the items with which it begins, each with
    cost and audit. A deduction takes an item to another: Keep, Rerole and Delete read a turn, Insert
    reads none. Items are popped by (cost, turns read, audit) and then final: every deduction leads
    to a higher place in this order, and of two audits of one item at one cost neither begins
    with the other (they hold the same number of letters for turns, so one could only be longer
    by an Insert, at a higher cost); so a lesser source gives a lesser result.
    ``turns``: (initial, must go, truncated, ...).
    """
    heap = [(cost, 0, audit, state) for state, (cost, audit) in front.items()]
    heapq.heapify(heap)
    done, found, n = set(), {}, len(turns)
    while heap:
        cost, at, audit, state = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == n:
            if final and state in ENDS:
                return {state: (cost, audit)}
            found[state] = cost, audit
            if not final and len(found) == len(AFTER):
                break
        heapq.heappush(heap, (cost + INSERT, at, audit + "I", AFTER[state][WANTED[state]]))
        if at == n:
            continue
        initial, goes, cut = turns[at][:3]
        heapq.heappush(heap, (cost + DELETE, at + 1, audit + "D", state))
        if goes:
            continue
        more = cost + CUT * cut
        if initial in AFTER[state]:
            heapq.heappush(heap, (more, at + 1, audit + "K", AFTER[state][initial]))
        heapq.heappush(heap, (more + RETITLE, at + 1, audit + "R", AFTER[state][WANTED[state]]))
    return found


class Conversation:
    """One conversation, read turn by turn; holds only turns whose edit isn't settled.

    ``out`` gets the repaired (role, text) in order. After every BLOCK turns the audits of all states
    are compared: what they begin with in common is settled, its turns are written and let go.
    """

    def __init__(self, out):
        self.out = out
        self.state, self.front, self.waiting = 0, {0: (0, "")}, []
        self.read, self.audit, self.cost = 0, [], 0
        self.last = self.first_turn = self.last_turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        bare = text.strip(" \t\n\x0b\x0c\r")
        blank, again = not bare, seen or self.last == (turn, role, text)
        cut = bool(bare) and not again and bare[-1] not in ".!?"
        self.blank += blank
        self.duplicate += not blank and again
        self.truncated += cut
        if self.last is not None and self.last[1][:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        if turn is not None:
            self.turns += self.last_turn != turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        self.last = turn, role, text
        self.waiting.append((role[:1], blank or again, cut, role, text))
        if len(self.waiting) - self.read >= BLOCK:
            self.front = agenda(self.front, self.waiting[self.read:], False)
            self.read = len(self.waiting)
            self._settle()

    def _settle(self) -> None:
        # A state from which even the best rest comes out dearer than another's can't win.
        cost = {s: c for s, (c, _) in self.front.items()}
        self.front = {s: v for s, v in self.front.items() if not any(
            v[0] > cost[t] + DEARER[s, t] for t in cost if (s, t) in DEARER)}
        audits = [a for _, a in self.front.values()]
        low, high = min(audits), max(audits)
        same = next((i for i, c in enumerate(low) if high[i: i + 1] != c), len(low))
        # Behind the last letter of a turn, so that no state's next Insert is cut off.
        same = max((low.rfind(c, 0, same) for c in "KRD"), default=-1) + 1
        self._write(low[:same])
        self.front = {s: (c, a[same:]) for s, (c, a) in self.front.items()}

    def _write(self, audit: str) -> None:
        at = 0
        for edit in audit:
            if edit == "I":
                role, text, initial = None, "", WANTED[self.state]
            else:
                initial, _, _, role, text = self.waiting[at]
                at += 1
                if edit == "D":
                    continue
                if edit == "R":
                    initial, role = WANTED[self.state], None
            self.state = AFTER[self.state][initial]
            self.out(role if role is not None else NAMES[initial], text)
        self.waiting = self.waiting[at:]
        self.read -= at
        self.audit.append(audit)

    def end(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit."""
        (cost, audit), = agenda(self.front, self.waiting[self.read:], True).values()
        self._write(audit)
        gaps = 0 if self.turns == 0 else self.last_turn - self.first_turn + 1 - self.turns
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost,
                "".join(self.audit))


def _conversations(batches: Iterator[pa.RecordBatch], start) -> Iterator:
    """Runs of rows of one conversation, ``start()`` before and the result of ``end`` behind each."""
    at, now = None, None
    for batch in batches:
        for key, turn, role, text, seen in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or key != at:
                if now is not None:
                    yield at, now
                at, now = key, start(key)
            now.add(turn, role, text, seen)
    if now is not None:
        yield at, now


_MARKS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _judged(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    hashes = []

    def start(_):
        digest, first = sha256(), [True]

        def out(role, text):
            digest.update((("" if first[0] else "\n") + role + ":" + text).encode("utf-8", "replace"))
            first[0] = False
        hashes.append(digest)
        return Conversation(out)

    rows = []
    for key, talk in _conversations(batches, start):
        rows.append((key, *talk.end(), hashes.pop(0).hexdigest()))
        if len(rows) == 10_000:
            yield _batch(rows, schema)
            rows = []
    yield _batch(rows, schema)


def _turns(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows = []

    def start(key):
        position = [0]

        def out(role, text):
            rows.append((key, position[0], role, text))
            position[0] += 1
        return Conversation(out)

    for _, talk in _conversations(batches, start):
        talk.end()
        if len(rows) >= 2_000:
            yield _batch(rows, schema)
            rows.clear()
    yield _batch(rows, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _in_order(rows: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows by conversation and turn, with whether an earlier turn had this role and text."""
    space = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    given = rows.select(named(key).alias("key"), named(turn).cast("long").alias("turn"),
                        space(named(role)).alias("role"), space(named(text)).alias("text"))
    marked = given.withColumn("mark", F.md5(F.col("text").cast("binary")))
    # Of texts that come more than once, the first turn; null turns come first.
    first = marked.groupBy(F.col("key").alias("k"), F.col("role").alias("r"),
                           F.col("mark").alias("m")).agg(
        F.count(F.lit(1)).alias("n"), F.min("turn").alias("least"),
        F.max(F.col("turn").isNull()).alias("unnumbered")).where(F.col("n") > 1)
    met = marked.join(first, F.col("key").eqNullSafe(F.col("k")) & (F.col("role") == F.col("r"))
                      & (F.col("mark") == F.col("m")), "left")
    later = F.col("n").isNotNull() & F.col("turn").isNotNull() & (
        F.col("unnumbered") | (F.col("turn") > F.col("least")))
    ready = met.select("key", "turn", "role", "text", F.coalesce(later, F.lit(False)).alias("seen"))
    return ready.repartition("key").sortWithinPartitions("key", "turn", "role", "text")


def repair(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """What is wrong with every conversation, and its cheapest repair.

    A conversation's rows are taken by turn, null turns first, rows of one turn by role and text.
    Each row's first fault counts: blank (nothing but ``[\\x20\\x09-\\x0D]``), duplicate (role and text seen
    earlier), truncated (the last other character is none of ``.!?``). Edits: Keep (0), Rerole to user
    or assistant (3), Delete (4; blank and duplicate turns must go), Insert an empty turn of user or
    assistant (3); a truncated turn that stays costs 3. The role initials that are left must read
    ``(s?(ua)+)?``. Of the cheapest repairs the one whose initials (the audit) come first in ASCII.

    Output, one row for each conversation: conv_id, gaps (turn numbers left out), blank, duplicate,
    truncated, illegal (neighbours whose initials aren't su, ua or au), cost, audit,
    repaired_sha256 (of ``role:text`` joined by newlines; of the empty text if nothing is left).
    Null role and null text are one space, an empty role has no initial and can't be kept; null keys are
    one conversation; equal rows of one turn are duplicates. An empty table gives an empty one. Other
    columns aren't read.

    Earlier turns are looked up by an aggregate and a join, so a task holds no set of texts; a
    conversation's rows come sorted by Spark and are read one after the other, as its one digest
    requires. A task holds the turns whose edit isn't settled yet, not the conversation.
    """
    ready = _in_order(rows, key, turn, role, text)
    kind = ready.schema["key"].dataType.simpleString()
    longs = ", ".join(f"{m} long" for m in _MARKS)
    return _shaped(ready, _judged, f"conv_id {kind}, {longs}, audit string, repaired_sha256 string")


def repaired_turns(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role",
                   text: str = "text") -> DataFrame:
    """The turns after the cheapest repair: conv_id, position from 0, role, text. See ``repair``."""
    ready = _in_order(rows, key, turn, role, text)
    kind = ready.schema["key"].dataType.simpleString()
    return _shaped(ready, _turns, f"conv_id {kind}, position long, role string, text string")


def _shaped(ready: DataFrame, function, schema: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    empty = ready.sparkSession.createDataFrame([], schema)
    return in_tasks(ready, partial(function, schema=to_arrow_schema(empty.schema)), schema)


def judged(rows: DataFrame, whole: DataFrame, key: str = "conv_id") -> DataFrame:
    """``repair`` of ``rows``, with zeros and an empty audit for the conversations of ``whole`` that
    have no row in it."""
    found = repair(rows)
    every = whole.select(named(key).alias("k")).distinct()
    met = every.join(found, F.col("k").eqNullSafe(F.col("conv_id")), "left")
    zero: Column = F.lit(0).cast("long")
    return met.select(
        F.col("k").alias("conv_id"), *[F.coalesce(F.col(m), zero).alias(m) for m in _MARKS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(sha256(b"").hexdigest())).alias("repaired_sha256"))
