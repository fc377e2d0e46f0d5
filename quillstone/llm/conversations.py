"""Repair of conversations whose rows were dropped, emptied, cut short, repeated or put under another role.

A conversation is right if its role initials read ``(s?(ua)+)?``. Its cheapest edits are found by A* on the lattice of (row,
state of that pattern). Conversations are cut into blocks of consecutive rows, so that none, however long, is searched in one
task: a block is searched from each state it may be entered in to each state it may be left in, and the paths of blocks are
joined in order. That finds what one search over the whole finds: of two paths of equal cost to one node neither audit begins
the other (what would follow is only insertions, and those cost), so appending the same edits keeps their order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush
from itertools import groupby
from math import inf

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import parts, stash
from .numbering import numbered

# Faults of a row, in the order in which they count, and what edits cost.
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
REROLE, DELETE, INSERT, TRUNCATION = 2, 3, 2, 1
#: Rows that one search takes.
BLOCK_ROWS = 512
_INK = r"[^\x20\x09-\x0D]"
# States of the pattern: nothing yet, after s, after u, after a; where user and assistant lead from each.
_STATES, _ENDS = range(4), (0, 3)
_USER, _ASSISTANT = {0: 2, 1: 2, 3: 2}, {2: 3}


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of a table after the damage of a test: crc32 of ``conv_id:turn`` modulo 20 says which.

    0 drops a row, 1 empties its text, 2 removes its sentence marks, 3 repeats it with the same turn, 4 makes the role user.
    Nulls are written as one space, in the sum too.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    some = rows.withColumn("_kind", kind).filter("_kind <> 0")
    times = F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1))
    return some.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), F.explode(times).alias("_")).drop("_")


def with_faults(rows: DataFrame) -> DataFrame:
    """g, at, n, turn, role, text and fault (the first that counts, or null) of rows (g, turn, role, text) in their order.

    Rows of a conversation stand by turn, nulls first, then by role and text. A row is a duplicate if an earlier one has its
    role and text: the first place of each pair is a minimum with partial sums, so a pair of very many rows is one row of the join.
    """
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    held = numbered(rows, "g", ["turn", "role", "text"]).withColumn("said", said)
    first = held.groupBy("g", "said").agg(F.min("at").alias("first"))
    last = F.regexp_extract("text", rf"({_INK})[\x20\x09-\x0D]*\z", 1)
    fault = F.when(~F.col("text").rlike(_INK), BLANK).when(F.col("first") < F.col("at"), DUPLICATE).when(~last.isin(".", "!", "?"), TRUNCATED)
    return held.join(first, ["g", "said"]).select("g", "at", "n", "turn", "role", "text", fault.alias("fault"))


def moves(state: int, initial: str, fault: str | None) -> Iterator[tuple[int, str, int]]:
    """(cost, edit, next state) of what may be done with a row: D, K or R."""
    yield DELETE, "D", state
    if fault in (BLANK, DUPLICATE):
        return
    charge = TRUNCATION if fault == TRUNCATED else 0
    to = 1 if initial == "s" and state == 0 else _USER.get(state) if initial == "u" else _ASSISTANT.get(state) if initial == "a" else None
    if to is not None:
        yield charge, "K", to
    to = _USER.get(state, _ASSISTANT.get(state))
    yield REROLE + charge, "R", to


def search(initials: list[str], faults: list[str | None], entered: int) -> dict[int, tuple[int, str]]:
    """The least (cost, audit) with which rows that are entered in one state are left in each state: A* over (row, state).

    The bound of what is still to pay is the sum, over the rows ahead, of deletions that must be and of the charges that
    neither keeping nor deleting a row avoids. It falls by no more than an edit costs, so a node is final when it is first taken.
    """
    n = len(initials)
    ahead = [0] * (n + 1)
    for k in range(n - 1, -1, -1):
        ahead[k] = ahead[k + 1] + (DELETE if faults[k] in (BLANK, DUPLICATE) else min(TRUNCATION, DELETE) if faults[k] else 0)
    heap, taken, out = [(ahead[0], "", 0, entered)], set(), {}
    while heap and len(out) < len(_STATES):
        bound, audit, k, state = heappop(heap)
        if (k, state) in taken:
            continue
        taken.add((k, state))
        cost = bound - ahead[k]
        if k == n:
            out[state] = cost, audit
        insert = _USER.get(state, _ASSISTANT.get(state))
        if (k, insert) not in taken:
            heappush(heap, (bound + INSERT, audit + "I", k, insert))
        if k < n:
            for paid, edit, to in moves(state, initials[k], faults[k]):
                if (k + 1, to) not in taken:
                    heappush(heap, (cost + paid + ahead[k + 1], audit + edit, k + 1, to))
    return out


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of batches as lists of equal first ``keys`` values; rows of a run lie side by side."""
    run: list[tuple] = []
    for b in batches:
        for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if run and run[0][:keys] != row[:keys]:
                yield run
                run = []
            run.append(row)
    if run:
        yield run


def _in_order(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return df.repartition(parts(df.sparkSession), *by).sortWithinPartitions(*by, *order)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1024) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_BLOCK = "g string, block bigint, initials string, illegal bigint, blank bigint, duplicate bigint, truncated bigint, came array<bigint>, left array<bigint>, cost array<bigint>, audit array<string>"
_CHOSEN = "g string, block bigint, edits array<string>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _mapped(df: DataFrame, step, schema: str) -> DataFrame:
    """mapInArrow with a generator of tuples from batches."""
    out = df.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(out)
    return df.mapInArrow(lambda batches: _batches(step(batches), arrow), out)


def _illegal(initials: str) -> int:
    return sum(initials[k : k + 2] not in ("su", "ua", "au") for k in range(len(initials) - 1))


def searched(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For each block of rows (g, at, role, fault): its initials (a point for any but s, u and a), its faults and the least paths through it."""
    initial = F.substring("role", 1, 1)
    small = rows.select("g", F.expr(f"at div {block_rows}").alias("block"), "at", F.when(initial.isin("s", "u", "a"), initial).otherwise(".").alias("initial"), "fault")

    def step(batches):
        for run in _runs(batches, 2):
            g, block = run[0][:2]
            initials, faults = [r[3] for r in run], [r[4] for r in run]
            paths = [(s, t, *best) for s in (_STATES if block else (0,)) for t, best in sorted(search(initials, faults, s).items())]
            came, left, cost, audit = map(list, zip(*paths, strict=True))
            yield g, block, "".join(initials), _illegal("".join(initials)), *[faults.count(c) for c in (BLANK, DUPLICATE, TRUNCATED)], came, left, cost, audit

    return _mapped(_in_order(small, ["g", "block"], ["at"]), step, _BLOCK)


def applied(audit: str, initials: str, state: int) -> list[str]:
    """An audit as one text a row: u and a stand for inserted rows, K, U, A and D for what becomes of the row itself.

    Insertions after the last row stand in a text of their own at the end, which may be empty.
    """
    out, now = [], ""
    for edit in audit:
        to = _USER.get(state, _ASSISTANT.get(state))
        if edit == "K" and state == 0 and initials[len(out)] == "s":
            to = 1
        if edit == "I":
            now += "u" if to == 2 else "a"
        else:
            out.append(now + (edit if edit in "DK" else "U" if to == 2 else "A"))
            now = ""
        state = state if edit == "D" else to
    return [*out, now]


def chosen(blocks: DataFrame) -> DataFrame:
    """g, block and edits (see :func:`applied`) of the cheapest path through each conversation; its last block has the sums and the audit.

    Blocks of a conversation are joined in order, with one path a state; a path is as long as its audit.
    """

    def step(batches):
        for g, run in groupby((row for r in _runs(batches, 2) for row in r), key=lambda row: row[0]):
            best, counts, edge = {0: (0, "", None)}, [0] * 4, ""
            for _, block, initials, illegal, blank, duplicate, truncated, came, left, cost, audit in run:
                counts = [a + b for a, b in zip(counts, (blank, duplicate, truncated, illegal + _illegal(edge + initials[0])), strict=True)]
                edge = initials[-1]
                met = {}
                for s, t, c, piece in zip(came, left, cost, audit, strict=True):
                    if s in best and ((path := (best[s][0] + c, best[s][1] + piece)) < met.get(t, (inf,))[:2]):
                        met[t] = (*path, (block, s, piece, initials, best[s][2]))
                best = met
            cost, audit, at = min((best[t] for t in _ENDS if t in best), key=lambda p: p[:2])
            last = at[0]
            while at:
                block, s, piece, initials, at = at
                yield g, block, applied(piece, initials, s), *([*counts, cost, audit] if block == last else [None] * 6)

    return _mapped(_in_order(blocks, ["g"], ["block"]), step, _CHOSEN)


@dataclass(frozen=True)
class Repair:
    """audits: g, blank, duplicate, truncated, illegal, cost, audit and gaps of each conversation; lines: g, at and, for each
    row that leaves any, the repaired rows in its place (role, text) in order."""

    audits: DataFrame
    lines: DataFrame


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> Repair:
    """The cheapest repair of each conversation of ``rows`` (conv_id, turn, role, text; other columns don't count).

    Nulls of role and text count as one space, so such a text is blank and such a role fits nowhere; a role without letters,
    or of another initial than s, u and a, fits nowhere either. A null conv_id is a conversation of its own, and rows
    without a turn come first. g names a conversation as :func:`named` does.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    held = stash(with_faults(rows.select(named("conv_id").alias("g"), "turn", blank("role"), blank("text"))))
    paths = stash(chosen(searched(held, block_rows)))
    turn = F.col("turn")
    gaps = held.groupBy("g").agg(F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).cast("bigint").alias("gaps"))
    audits = paths.filter("audit is not null").drop("block", "edits").join(gaps, "g")
    met = held.withColumn("block", F.expr(f"at div {block_rows}")).join(paths.select("g", "block", "edits"), ["g", "block"])
    nth = (F.col("at") - F.col("block") * block_rows).cast("int")
    edit = F.concat(F.get("edits", nth), F.when(nth == F.size("edits") - 2, F.get("edits", nth + 1)).otherwise(""))
    own = lambda e: F.when(e == "K", F.col("role")).when(e == "U", "user").otherwise("assistant")
    line = lambda e: F.when(e.isin("u", "a"), F.struct(F.when(e == "u", "user").otherwise("assistant").alias("role"), F.lit("").alias("text"))).otherwise(F.struct(own(e).alias("role"), F.col("text").alias("text")))
    each = met.select("g", "at", "role", "text", F.filter(F.regexp_extract_all(edit, F.lit("(.)"), F.lit(1)), lambda e: e != "D").alias("e"))
    return Repair(audits, each.filter(F.size("e") > 0).select("g", "at", F.transform("e", line).alias("lines")))


def named(conv_id: str) -> Column:
    """A conversation's name, which null has too."""
    return F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit(""))


def hashed(lines: DataFrame) -> DataFrame:
    """g, sha256 of each conversation's repaired ``role:text`` lines, joined by line breaks.

    The digest is made as the sorted lines stream by, so memory doesn't follow a conversation's length; a digest's
    bytes come one after another by its nature, so the lines of one conversation are read by one task.
    """
    text = F.array_join(F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")

    def step(batches):
        now, digest = None, None
        for b in batches:
            for g, _, piece in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if g != now:
                    if now is not None:
                        yield now, digest.hexdigest()
                    now, digest = g, hashlib.sha256(piece.encode())
                else:
                    digest.update(b"\n" + piece.encode())
        if now is not None:
            yield now, digest.hexdigest()

    return _mapped(_in_order(lines.select("g", "at", text.alias("piece")), ["g"], ["at"]), step, "g string, sha256 string")


def reports(rows: DataFrame, of: DataFrame) -> DataFrame:
    """A row for each conv_id of ``of``: gaps, faults, cost, audit and the digest of the repaired ``rows``; zeros and empty texts for those without rows."""
    done = repair(rows)
    ids = of.select("conv_id").distinct().withColumn("g", named("conv_id"))
    met = ids.join(done.audits, "g", "left").join(hashed(done.lines), "g", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", BLANK, DUPLICATE, TRUNCATED, "illegal", "cost")]
    return met.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
