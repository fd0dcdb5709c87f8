"""Repair of damaged conversations: the cheapest edits that give system? (user assistant)+, found by depth-first branch-and-bound.

A row is kept, given the next legal role, deleted, or has empty turns inserted before it; the last rows may be followed by
inserted turns. After any prefix only one of user and assistant can follow, so an audit, the initials of the edits in
order, says all. The search keeps an explicit stack of prefixes. Suffix lower bounds are what the rows from a place on
cost at least from each of the four states of the pattern, by one sweep from the end. A prefix is cut if its cost and
bound exceed the incumbent (cost, audit), or if the dominance table of its node (place, state) has seen one at no higher
cost: children are taken in order of cost and bound, then of initials, so an earlier one of equal cost has the smaller
audit. The search ends when nothing is left that could beat the incumbent.

Rows are shuffled once, by conversation: each conversation's faults come first, as one byte a row, then its texts, which
are hashed or passed on one by one. So a task holds a few bytes for each row of one conversation, never its texts. The
rows of one conversation do meet in one task, as its hash runs over them in order.

Null role and text become one space; a null turn comes first and is written as one space in the damage key, a null
conv_id is a conversation of its own. Rows of equal turn are ordered by role and a digest of the text. Repeated rows are rows like others.
A conversation without rows after damage has zeros, an empty audit and the hash of nothing. An empty table gives no rows;
further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: What edits cost, and what a truncated row adds that is not deleted.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing yet, after system, after user, after assistant. What may follow each, and where it leads.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
FOLLOWS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (START, ASSISTANT)
#: A row as one byte: its initial (none of s, u, a: 0) and, times four, its fault.
INITIALS, FINE, CUT, DEAD = ("", "s", "u", "a"), 0, 1, 2
FAR = 1 << 40
DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped): rows as the fixed damage leaves them; a dropped row stays as a mark that its conversation exists."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), (kind == 0).alias("dropped"),
        F.when(kind == 3, 2).otherwise(1).alias("_times"),
    )
    return rows.withColumn("_times", F.explode(F.sequence(F.lit(1), "_times"))).drop("_times")


def _fault(text: Column) -> Column:
    """1 blank, 3 truncated, else 0."""
    end = F.right(F.rtrim(F.translate(text, "\t\n\x0b\x0c\r", "     ")), F.lit(1))
    return F.when(end == "", 1).when(~end.isin(".", "!", "?"), 3).otherwise(0)


def ordered(rows: DataFrame) -> DataFrame:
    """(conv_id, part, turn, role, fault, text): one shuffle by conversation; part 0 has the rows' faults, part 1 their texts, each in order."""
    both = F.explode(F.when(F.col("dropped"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1))))
    parts = rows.repartition("conv_id").select("conv_id", "turn", "role", "text", "dropped", _fault(F.col("text")).alias("_fault"), F.md5("text").alias("_key"), both.alias("part"))
    parts = parts.withColumn("text", F.when(F.col("part") == 1, F.col("text")))
    same = Window.partitionBy("conv_id", "part", "dropped", "role", "_key").orderBy(F.col("turn").asc_nulls_first())
    fault = F.when((F.col("part") == 0) & ~F.col("dropped"), F.when((F.col("_fault") != 1) & (F.row_number().over(same) > 1), 2).otherwise(F.col("_fault")))
    flat = parts.select("conv_id", "part", "turn", "role", fault.alias("fault"), "text", "_key")  # fault: 1 blank, 2 duplicate, 3 truncated; null beside texts and for dropped rows
    return flat.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part", F.col("turn").asc_nulls_first(), "role", "_key").drop("_key")


def suffix_bounds(symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """What rows i.. cost at least from each state: a base for each i, and what a state costs above it (at most two inserts)."""
    n = len(symbols)
    base, above = np.zeros(n + 1, dtype=np.int64), np.zeros((n + 1, 4), dtype=np.int8)
    total, later = 0, [0, 2 * INSERT, INSERT, 0]
    above[n] = later
    for i in range(n - 1, -1, -1):
        fault, initial = divmod(symbols[i], 4)
        here = [DELETE + later[q] for q in range(4)]
        if fault != DEAD:
            more = TRUNCATED * (fault == CUT)
            for q in range(4):
                to = FOLLOWS.get((q, INITIALS[initial]))
                kept = more + later[to] if to is not None else FAR
                here[q] = min(here[q], kept, more + REROLE + later[NEXT[q]])
        for _ in range(2):  # inserts before the row; a third leads back
            here = [min(here[q], INSERT + here[NEXT[q]]) for q in range(4)]
        low = min(here)
        total += low
        later = [h - low for h in here]
        base[i], above[i] = total, later
    return base, above


def search(symbols: bytes) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits; of equal ones the audit that is least in ASCII."""
    n = len(symbols)
    base, above = suffix_bounds(symbols)
    bound = lambda i, q: int(base[i]) + int(above[i, q])
    best: tuple[float, str] = (float("inf"), "")
    seen: dict[tuple[int, int], int] = {}
    trail = bytearray()  # the initials of the prefix at hand
    stack = [(0, START, 0, 0, "")]  # place, state, cost, length of the prefix before, its last initial
    while stack:
        i, q, cost, length, letter = stack.pop()
        del trail[length:]
        trail += letter.encode()
        if cost + bound(i, q) >= best[0] or seen.get((i, q), FAR) <= cost:
            continue
        seen[i, q] = cost
        if i == n and q in ENDS:
            best = (cost, trail.decode())
            continue
        children = [(cost + INSERT, "I", i, NEXT[q])]
        if i < n:
            fault, initial = divmod(symbols[i], 4)
            children.append((cost + DELETE, "D", i + 1, q))
            if fault != DEAD:
                more = cost + TRUNCATED * (fault == CUT)
                to = FOLLOWS.get((q, INITIALS[initial]))
                if to is not None:
                    children.append((more, "K", i + 1, to))
                children.append((more + REROLE, "R", i + 1, NEXT[q]))
        least = bound(i, q)
        ranked = sorted((c + bound(j, to), letter, c, j, to) for c, letter, j, to in children)
        at = len(trail)
        # what costs more than the rows must from here on can never be in the answer: the bound is reached
        stack += [(j, to, c, at, x) for f, x, c, j, to in reversed(ranked) if f < best[0] and f <= cost + least]
    return int(best[0]), best[1]


@lru_cache(maxsize=1 << 15)
def _short(symbols: bytes) -> tuple[int, str]:
    return search(symbols)


def repair(symbols: bytes) -> tuple[int, str]:
    return _short(symbols) if len(symbols) <= 64 else search(symbols)


class Conversation:
    """One conversation as it comes: faults and turns first, then texts, which leave as repaired rows."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.symbols, self.faults = conv_id, bytearray(), [0, 0, 0, 0]
        self.least = self.most = self.turn = None
        self.distinct = self.illegal = 0
        self.last, self.at, self.state, self.solved = None, 0, START, None

    def fault(self, turn: int | None, role: str, fault: int) -> None:
        initial = role[:1]
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        if turn is not None and turn != self.turn:  # turns come in order
            self.least = turn if self.least is None else self.least
            self.most = self.turn = turn
            self.distinct += 1
        self.faults[fault] += 1
        self.symbols.append((INITIALS.index(initial) if initial in INITIALS else 0) + 4 * (FINE, DEAD, DEAD, CUT)[fault])

    def _solve(self) -> None:
        if self.solved is None:
            self.solved = repair(bytes(self.symbols))

    def _inserted(self) -> Iterator[tuple[str, str]]:
        audit = self.solved[1]
        while self.at < len(audit) and audit[self.at] == "I":
            self.state = NEXT[self.state]
            self.at += 1
            yield "user" if self.state == USER else "assistant", ""

    def text(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        """The repaired rows up to this one."""
        self._solve()
        yield from self._inserted()
        edit = self.solved[1][self.at]
        self.at += 1
        if edit == "K":
            self.state = FOLLOWS[self.state, role[:1]]
            yield role, text
        elif edit == "R":
            self.state = NEXT[self.state]
            yield "user" if self.state == USER else "assistant", text

    def end(self) -> Iterator[tuple[str, str]]:
        self._solve()
        yield from self._inserted()

    def counts(self) -> tuple[int, ...]:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        return gaps, *self.faults[1:], self.illegal


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Conversation, Iterator[tuple[str, str]], bool]]:
    """(conversation, repaired rows that one more row gives, whether it ends there), from ordered rows."""
    now = None
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            for conv_id, part, turn, role, fault, text in zip(*[c.to_pylist() for c in batch.slice(start, 1024).columns], strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        yield now, now.end(), True
                    now = Conversation(conv_id)
                if part:
                    yield now, now.text(role, text), False
                elif fault is not None:
                    now.fault(turn, role, fault)
    if now is not None:
        yield now, now.end(), True


def _mapped(turns: DataFrame, damage: bool) -> DataFrame:
    rows = damaged(turns) if damage else turns.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")], F.lit(False).alias("dropped"))
    return ordered(rows)


def _emitted(schema: T.StructType, made: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Tuples as batches of bounded size."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in made(batches):
            rows.append(row)
            size += sum(len(x) for x in row if isinstance(x, str))
            if len(rows) >= 4096 or size > 1 << 24:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)

    return run


def digests(turns: DataFrame, damage: bool = True) -> DataFrame:
    """A row for each conv_id: gaps, faults, illegal neighbours, cost and audit of the repair, and the hash of the repaired rows."""
    rows = _mapped(turns, damage)
    schema = T.StructType([rows.schema["conv_id"], *T.StructType.fromDDL(DIGEST).fields[1:]])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        hashed, first = hashlib.sha256(), True
        for c, repaired, over in _conversations(batches):
            for role, text in repaired:
                hashed.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
                first = False
            if over:
                yield c.conv_id, *c.counts(), *c.solved, hashed.hexdigest()
                hashed, first = hashlib.sha256(), True

    return rows.mapInArrow(_emitted(schema, made), schema)


def repaired(turns: DataFrame, damage: bool = False) -> DataFrame:
    """(conv_id, position, role, text): the rows of each repaired conversation, numbered from 0."""
    rows = _mapped(turns, damage)
    schema = T.StructType([rows.schema["conv_id"], T.StructField("position", T.LongType()), rows.schema["role"], rows.schema["text"]])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        position = 0
        for c, now, over in _conversations(batches):
            for role, text in now:
                yield c.conv_id, position, role, text
                position += 1
            if over:
                position = 0

    return rows.mapInArrow(_emitted(schema, made), schema)
