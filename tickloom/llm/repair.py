"""Repair of conversation structure by iterative-deepening A*.

Roles must read ``(s?(ua)+)?`` by their initials.  Edits in ASCII order: Delete 3, Insert an
empty user or assistant turn 2, Keep 0, Rerole to user or assistant 2; a truncated turn that is
not deleted costs 1 more, blank turns and duplicates must be deleted.  ``search`` walks the
edits depth first in that order under a cost bound, remembers the states that failed, and
raises the bound to the least cost that went beyond it; the first path that is accepted is the
cheapest and, among the cheapest, the least in ASCII order.

A conversation is cut into blocks of ``BLOCK`` turns.  A block is searched for every pair of
grammar states at its ends, on two characters a turn, and the blocks of a conversation are
joined pairwise: inserts stand before a turn or at the very end, so no audit of a block is the
start of another one and the least whole is made of least blocks.  Texts never enter a search.
The repaired text is hashed as its rows stream by in order, one row at a time, so a
conversation of any length needs neither one large group nor one large string.

Cases: null conv_id, turn, role and text count as one space (a null conv_id is a conversation
of its own and stays null in the result); turns are ordered nulls first, then by role and text;
rows of equal turn, role and text are interchangeable; conversations without rows left have
zeros, an empty audit and the hash of the empty string; an empty table gives no rows; columns
beyond conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLOCK = 64
START, SYSTEM, USER, ASSISTANT = range(4)  # grammar state: by the initial that was read last
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ACCEPTS = (START, ASSISTANT)
WANTED = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}  # what an insert or a new role gives
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1

Answer = tuple[int, str]


def least_costs(initials: str, faults: str) -> list[int]:
    """For every turn, a bound from below on the cost of it and all later ones."""
    out = [0]
    for role, fault in zip(reversed(initials), reversed(faults), strict=True):
        if fault in "bd":
            cost = DELETE
        else:
            cost = (0 if role in "sua" else REROLE) + (TRUNCATED if fault == "t" else 0)
        out.append(out[-1] + min(cost, DELETE))
    return out[::-1]


def edits(i: int, state: int, initials: str, faults: str, inserts: bool) -> Iterator[tuple[str, int, int, int]]:
    """(letter, cost, next turn, next state) in ASCII order of the letter."""
    here = i < len(initials)
    if here:
        yield "D", DELETE, i + 1, state
    if here or inserts:
        yield "I", INSERT, i, NEXT[state][WANTED[state]]
    if here and faults[i] not in "bd":
        more = TRUNCATED if faults[i] == "t" else 0
        if initials[i] in NEXT[state]:
            yield "K", more, i + 1, NEXT[state][initials[i]]
        yield "R", REROLE + more, i + 1, NEXT[state][WANTED[state]]


def search(initials: str, faults: str, start: int = START, goals: tuple[int, ...] = ACCEPTS, last: bool = True) -> Answer:
    """Cost and audit of the least path over all turns from ``start`` to one of ``goals``.

    ``faults`` has b, d, t or - for each turn.  ``last`` allows inserts behind the last turn.
    A goal must be reachable.
    """
    n, ahead = len(initials), least_costs(initials, faults)
    most = (DELETE + 2 * INSERT) * (n + 1)

    def rest(j: int, state: int) -> int:
        """A bound from below on what follows; to end before the first user turn, all else must be deleted."""
        if goals not in ((START,), (SYSTEM,)):
            return ahead[j]
        if state not in (START, *goals):
            return most + 1
        return max(ahead[j] if state in goals else 0, DELETE * (n - j - (state not in goals)))

    bound = rest(0, start)
    while bound <= most:
        beyond, failed = most + 1, {}
        path: list[str] = []
        stack = [(0, start, 0, edits(0, start, initials, faults, last))]
        while stack:
            i, state, spent, left = stack[-1]
            if i == n and state in goals:
                return spent, "".join(path)
            for letter, cost, j, then in left:
                total = spent + cost
                least = total + rest(j, then)
                if least > bound:
                    beyond = min(beyond, least)
                elif failed.get((j, then), most + 1) > total:
                    path.append(letter)
                    stack.append((j, then, total, edits(j, then, initials, faults, last)))
                    break
            else:
                failed[i, state] = min(spent, failed.get((i, state), most + 1))
                stack.pop()
                if path:
                    path.pop()
        bound = beyond
    raise ValueError("no edits lead to the goal")


def reachable(initials: str, faults: str, start: int, end: int) -> bool:
    """Whether a block can lead from ``start`` to ``end`` at all: nothing leads back to the first two states."""
    if end == SYSTEM and start == START:
        return any(role == "s" and fault not in "bd" for role, fault in zip(initials, faults, strict=True))
    return end not in (START, SYSTEM) or start == end


def block_table(initials: str, faults: str, first: bool, last: bool) -> list[tuple[int, int, int, str]]:
    """(start, end, cost, audit) for all pairs of states that a block can be entered and left in."""
    starts, ends = (START,) if first else NEXT, ACCEPTS if last else NEXT
    if first and last:
        answer = search(initials, faults)
        state = START if set(answer[1]) <= {"D"} else ASSISTANT
        return [(START, state, *answer)]
    pairs = [(a, b) for a in starts for b in ends if reachable(initials, faults, a, b)]
    return [(a, b, *search(initials, faults, a, (b,), last)) for a, b in pairs]


def joined(left: dict, right: dict) -> dict:
    """Least (cost, audit) over two neighbouring tables keyed (start, end)."""
    out: dict[tuple[int, int], Answer] = {}
    for (a, b), (cost, audit) in left.items():
        for (c, d), (more, rest) in right.items():
            if b == c and ((a, d) not in out or (cost + more, audit + rest) < out[a, d]):
                out[a, d] = (cost + more, audit + rest)
    return out


def compose(tables: list[dict]) -> Answer:
    """Tables of one conversation, in order, joined pairwise."""
    while len(tables) > 1:
        tables = [joined(*tables[k : k + 2]) if k + 1 < len(tables) else tables[k] for k in range(0, len(tables), 2)]
    return min(tables[0][START, end] for end in ACCEPTS if (START, end) in tables[0])


def block_tables(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Each block's table as text, ``start end cost audit`` on a line."""
    for args in batches:
        yield pd.Series(["\n".join(" ".join(map(str, row)) for row in block_table(*one)) for one in zip(*args, strict=True)], dtype=object)


def read_table(text: str) -> dict:
    rows = (line.split(" ") for line in text.split("\n"))
    return {(int(start), int(end)): (int(cost), audit) for start, end, cost, audit in rows}


def composed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for found in batches:
        yield pd.DataFrame([compose([read_table(t) for t in one]) for one in found], columns=["cost", "audit"])


def filled(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv, conv_id, turn, role and text after the damage of each row by the crc32 of ``conv_id:turn`` modulo 20.

    ``conv`` is one string for the id, so that a null id groups and joins like any other.
    """
    named = F.concat(F.col("conv_id").isNull().cast("int").cast("string"), filled("conv_id"))
    kind = F.crc32(F.concat_ws(":", filled("conv_id"), filled("turn")).cast("binary")) % 20
    rows = conversations.select(named.alias("conv"), "conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv", "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def judged(rows: DataFrame) -> DataFrame:
    """Rows in place: conv, position (from 0), turn, role, text, fault (b, d, t or -) and illegal.

    All windows share the shuffle by conversation.
    """
    numbered = rows.withColumn("position", F.row_number().over(Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")) - 1)
    initial = F.substring("role", 1, 1)
    before = F.lag(initial).over(Window.partitionBy("conv").orderBy("position"))
    again = F.row_number().over(Window.partitionBy("conv", "role", "text").orderBy("position")) > 1
    body = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    fault = F.when(body == "", "b").when(again, "d").when(~F.substring(body, -1, 1).isin(".", "!", "?"), "t").otherwise("-")
    illegal = before.isNotNull() & ~F.concat(before, initial).isin("su", "ua", "au")
    return numbered.select("conv", "position", "turn", "role", "text", fault.alias("fault"), illegal.alias("illegal"))


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, repaired_sha256) from (conv, ops, role, text): each row's edits, then the row; a hash stays open over batches."""
    full = {"u": "user", "a": "assistant"}
    conv, digest, state, fresh, letter = None, None, START, True, ""

    def turn(op: str, role: str | None, text: str) -> None:
        nonlocal state, fresh
        initial = role[:1] if op == "K" else WANTED[state]
        state = NEXT[state][initial]
        line = f"{role if op == 'K' else full[initial]}:{text}"
        digest.update((line if fresh else "\n" + line).encode("utf-8", "surrogatepass"))
        fresh = False

    def batch(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string()) for k in (0, 1)], ["conv", "repaired_sha256"])

    for rows in batches:
        done = []
        for key, ops, role, text in zip(*(rows.column(c).to_pylist() for c in ("conv", "ops", "role", "text")), strict=True):
            if key != conv:
                if digest is not None:
                    done.append((conv, digest.hexdigest()))
                conv, digest, state, fresh = key, hashlib.sha256(), START, True
            if ops is not None:
                for op in ops.rstrip("DKR"):
                    turn(op, None, "")
                letter = ops[-1]
            elif letter != "D":
                turn(letter, role, text)
        yield batch(done)
    if digest is not None:
        yield batch([(conv, digest.hexdigest())])


def audited(rows: DataFrame) -> DataFrame:
    """conv, cost and audit of every conversation with rows in ``rows``, as ``judged`` gives them."""
    initial = F.substring("role", 1, 1)
    spelled = F.array_sort(F.collect_list(F.struct("position", F.when(initial == "", "-").otherwise(initial).alias("initial"), "fault")))
    blocks = rows.groupBy("conv", F.floor(F.col("position") / BLOCK).alias("block")).agg(spelled.alias("turns"))
    ends = rows.groupBy("conv").agg(F.max("position").alias("end"))
    placed = blocks.join(ends, "conv").select(
        "conv",
        "block",
        F.array_join(F.col("turns.initial"), "").alias("initials"),
        F.array_join(F.col("turns.fault"), "").alias("faults"),
        (F.col("block") == 0).alias("first"),
        ((F.col("block") + 1) * BLOCK > F.col("end")).alias("last"),
    )
    searched = placed.select("conv", "block", F.pandas_udf(block_tables, "string")("initials", "faults", "first", "last").alias("found"))
    tables = searched.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "found"))).alias("tables"))
    return tables.select("conv", F.pandas_udf(composed, "cost long, audit string")(F.col("tables.found")).alias("r")).select("conv", "r.*")


def repaired(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 for every conv_id of ``conversations``."""
    given = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = written(judged(damaged(given)), "repair-rows")
    spread = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    names = {"blank": "b", "duplicate": "d", "truncated": "t"}
    faults = [F.count_if(F.col("fault") == letter).alias(name) for name, letter in names.items()]
    counts = rows.groupBy("conv").agg(F.coalesce(spread, F.lit(0)).alias("gaps"), *faults, F.count_if("illegal").alias("illegal"))
    audits = written(audited(rows), "repair-audits")
    # Each row meets its edits, and the end of the conversation the inserts behind its last row.
    steps = audits.select("conv", F.posexplode(F.regexp_extract_all("audit", F.lit("I*[DKR]|I+$"), F.lit(0))).alias("position", "ops"))
    nothing = F.lit(None).cast("string")
    both = steps.withColumns({"role": nothing, "text": nothing}).unionByName(rows.select("conv", "position", nothing.alias("ops"), "role", "text"))
    stream = both.repartition("conv").sortWithinPartitions("conv", "position", F.col("ops").asc_nulls_last()).drop("position")
    digests = stream.mapInArrow(hashed, "conv string, repaired_sha256 string")
    every = given.select("conv_id", F.concat(F.col("conv_id").isNull().cast("int").cast("string"), filled("conv_id")).alias("conv")).distinct()
    joined_up = every.join(counts, "conv", "left").join(audits, "conv", "left").join(digests, "conv", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *names, "illegal", "cost")]
    return joined_up.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
