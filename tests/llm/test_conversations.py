"""Conversation repair against a brute-force search over edits, at any block size."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quillstone.llm import conversations

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        ink = text.strip(SPACE)
        out.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, lines): every path, as a table of the least by rows read, state and insertions in a row, with no bound."""
    found, kinds = {(0, ""): (0, "", [])}, faults(rows)
    legal = lambda a, b: b in {"": "su", "s": "u", "u": "a", "a": "u"}[a]

    def better(at, k, state, new):
        if (k, state) not in at or new[:2] < at[k, state][:2]:
            at[k, state] = new
            return True
        return False

    for k in range(len(rows) + 1):
        moved = True
        while moved:
            moved = False
            for state in ("", "s", "u", "a"):
                if (k, state) in found:
                    cost, audit, lines = found[k, state]
                    for role in ("user", "assistant"):
                        if legal(state, role[0]):
                            moved |= better(found, k, role[0], (cost + 2, audit + "I", [*lines, f"{role}:"]))
        if k == len(rows):
            break
        role, text = rows[k]
        charge = kinds[k] == "truncated"
        for state in ("", "s", "u", "a"):
            if (k, state) not in found:
                continue
            cost, audit, lines = found[k, state]
            better(found, k + 1, state, (cost + 3, audit + "D", lines))
            if kinds[k] in ("blank", "duplicate"):
                continue
            if role[:1] in ("s", "u", "a") and legal(state, role[0]):
                better(found, k + 1, role[0], (cost + charge, audit + "K", [*lines, f"{role}:{text}"]))
            for to in ("user", "assistant"):
                if legal(state, to[0]):
                    better(found, k + 1, to[0], (cost + charge + 2, audit + "R", [*lines, f"{to}:{text}"]))
    return min((found[len(rows), s] for s in ("", "a") if (len(rows), s) in found), key=lambda x: x[:2])


def expected(rows):
    """Report of one conversation's rows (turn, role, text) after damage."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    pairs = [r[1:] for r in rows]
    kinds, turns = faults(pairs), [t for t, _, _ in rows if t is not None]
    cost, audit, lines = cheapest(pairs)
    initial = [r[:1] for r, _ in pairs]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initial, initial[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def random_rows(rng, conv, n):
    return [(conv, rng.choice([None, *range(n)]), rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None]), rng.choice(["One.", "Two!", "three", " ", "", None, "a. \n", f"{rng.random()}."])) for _ in range(n)]


@pytest.mark.parametrize("block_rows", [1, 3, 512])
def test_repair_is_the_cheapest(spark, block_rows):
    rng = random.Random(block_rows)
    rows = [r for conv in [*range(40), None] for r in random_rows(rng, conv, rng.choice([1, 2, 5, 9, 30]))]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", g string").withColumnRenamed("g", "at").withColumn("block", F.lit(1)).repartition(3)
    done = conversations.repair(df, block_rows)
    digests = {r["g"]: r["sha256"] for r in conversations.hashed(done.lines).collect()}
    columns = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    got = {r["g"]: (*[r[c] for c in columns], digests.get(r["g"], hashlib.sha256(b"").hexdigest())) for r in done.audits.collect()}
    assert got == {"" if conv is None else f"={conv}": expected([r[1:] for r in rows if r[0] == conv]) for conv in {r[0] for r in rows}}


def test_search_agrees_with_every_path():
    rng = random.Random(5)
    for _ in range(300):
        rows = [r[2:] for r in random_rows(rng, 0, rng.randrange(7))]
        rows = [(" " if r is None else r, " " if t is None else t) for r, t in rows]
        found = conversations.search([r[:1] for r, _ in rows], faults(rows), 0)
        assert min(found[s] for s in (0, 3) if s in found) == cheapest(rows)[:2]


def test_damage_and_reports(spark):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["Yes. No", "why?", None])) for c in range(60) for t in range(3)]
    rows += [(7, None, "user", "No turn."), (None, 1, "user", "No conversation.")]
    df = spark.createDataFrame(rows, SCHEMA)
    after = {}
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = {1: "", 2: text.replace(".", "").replace("?", "")}.get(kind, text)
        after.setdefault(c, []).extend([(t, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1))
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.reports(conversations.damaged(df), df).collect()}
    assert got == {c: expected(r) if r else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, r in after.items()}


def test_no_rows_and_one_long_conversation(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversations.reports(empty, empty).collect() == []
    rows = [(1, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(1300)]
    del rows[700]
    long = spark.createDataFrame([*rows, (2, 0, "user", "x" * 200_000)], SCHEMA)
    got = {r["conv_id"]: r for r in conversations.reports(long, long).collect()}
    assert got[1]["gaps"] == 1 and tuple(got[1])[1:] == expected([r[1:] for r in rows])
    assert (got[2]["truncated"], got[2]["cost"], got[2]["audit"]) == (1, 3, "D")


def test_lines_are_legal_conversations(spark):
    rng = random.Random(3)
    rows = [r for conv in range(10) for r in random_rows(rng, conv, 8)]
    lines = conversations.repair(spark.createDataFrame(rows, SCHEMA)).lines.select("g", "at", F.posexplode("lines")).orderBy("g", "at", "pos").select("g", "col.role").collect()
    by = {}
    for r in lines:
        by[r["g"]] = by.get(r["g"], "") + r["role"][0]
    assert by and all(x.lstrip("s") == "ua" * (len(x.lstrip("s")) // 2) and x.count("s") < 2 for x in by.values())
