import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from spanloom.llm import repair

LEGAL = re.compile(r"(s?(ua)+)?")


def plain_faults(rows):
    """rows: (role, text) in order."""
    out, seen = [], set()
    for role, text in rows:
        body = text.strip(repair.SPACE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def brute(rows):
    """Every way to edit the rows, with up to three insertions at each place: the cheapest, then least letters, and the texts it gives."""
    faults, made = plain_faults(rows), []
    roles = {"u": "user", "a": "assistant"}

    @cache
    def prefixes(initials):  # whether something legal begins so
        return any(LEGAL.fullmatch(initials + more) for more in ("", "u", "a", "ua", "aua", "uaua"))

    def go(k, cost, letters, initials, out, inserted):
        if not prefixes(initials):
            return
        if k == len(rows) and LEGAL.fullmatch(initials):
            made.append((cost, letters, out))
        if inserted < 3:
            for i, r in roles.items():
                go(k, cost + 5, letters + "I", initials + i, (*out, f"{r}:"), inserted + 1)
        if k < len(rows):
            (role, text), fault = rows[k], faults[k]
            go(k + 1, cost + 2, letters + "D", initials, out, 0)
            if fault not in ("blank", "duplicate"):
                more = 5 if fault else 0
                go(k + 1, cost + more, letters + "K", initials + (role[:1] or "-"), (*out, f"{role}:{text}"), 0)
                for i, r in roles.items():
                    go(k + 1, cost + 1 + more, letters + "R", initials + i, (*out, f"{r}:{text}"), 0)

    go(0, 0, "", "", (), 0)
    cost, letters, out = min(made)
    return cost, letters, "\n".join(out)


def plain_walk(rows):
    """The two streams of one conversation, without Spark."""
    edits = [repair.arcs(role[:1], fault) for (role, _), fault in zip(rows, plain_faults(rows), strict=True)]
    to_end = [repair.LAST]
    for e in reversed(edits):
        to_end.append(repair.before(to_end[-1], e))
    to_end.reverse()
    walk, letters = repair.Walk(to_end[0][repair.START]), ""
    for k, e in enumerate(edits):
        inserted, letter, _ = walk.row(to_end[k], to_end[k + 1], e)
        letters += "I" * len(inserted) + letter
    return walk.total, letters + "I" * len(walk.end())


ROLES = ["user", "user", "assistant", "assistant", "system", "tool", "", " ", "usage"]
TEXTS = ["a.", "b!", "c", "", " ", "d?\n", "e. f", "\x0b", "g.", "h!"]


@pytest.mark.parametrize("seed", range(6))
def test_walk_against_every_way(seed):
    r = random.Random(seed)
    for _ in range(60):
        rows = [(r.choice(ROLES), r.choice(TEXTS)) for _ in range(r.randrange(5))]
        assert plain_walk(rows) == brute(rows)[:2], rows


def wanted(log):
    """log: (conv_id, turn, role, text) as given. What op11 must return, by conversation."""
    word = lambda x: " " if x is None else str(x)
    out = {}
    for conv, turn, role, text in log:
        own, d = out.setdefault(conv, []), zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
        role, text = word(role), word(text)
        row = (turn is not None, turn or 0, "user" if d == 4 else role, "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text)
        own += [] if d == 0 else [row] * (2 if d == 3 else 1)
    found = {}
    for conv, own in out.items():
        own.sort()
        rows, turns = [x[2:] for x in own], {x[1] for x in own if x[0]}
        faults = plain_faults(rows)
        cost, audit, text = brute(rows)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        found[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return found


SCHEMA = "conv_id long, turn long, role string, text string"


def test_op11_against_every_way(spark):
    """Nulls in any column, turns that tie or are absent, rows repeated whole, conversations of which nothing is left."""
    r = random.Random(5)
    log = [(r.choice([None, *range(60)]) if k % 9 else 100 + k, r.choice([None, 0, 0, 1, 2, 3, 7]), r.choice([*ROLES, None]), r.choice([*TEXTS, None])) for k in range(200)]
    most = {}
    for x in log:
        most.setdefault(x[0], []).append(x)
    log = [x for rows in most.values() for x in rows[:4]]
    log += log[3:9] + [(1000, t, "user", "gone.") for t in range(2000) if zlib.crc32(f"1000:{t}".encode()) % 20 == 0][:3]
    got = {x.conv_id: tuple(x)[1:] for x in repair.op11(spark.createDataFrame(log, SCHEMA)).collect()}
    assert got == wanted(log)
    assert got[1000] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_steps_rebuild_the_conversation(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "user", "q?"), (1, 2, "user", "q?"), (1, 3, "tool", "x."), (1, 4, "user", "and?"), (2, 0, "assistant", "hi.")]
    steps = repair.repair(spark.createDataFrame(rows, SCHEMA)).collect()
    assert "".join(x.edit for x in steps if x.conv_id == 1) == "KKDDR"
    assert [(x.role, x.text) for x in steps if x.conv_id == 1 and x.role] == [("system", "s."), ("user", "q?"), ("assistant", "and?")]
    assert [x.step for x in steps if x.conv_id == 1] == list(range(5))
    assert [(x.edit, x.was, x.role, x.cost) for x in steps if x.conv_id == 2] == [("D", "assistant", None, 2)]


def test_one_long_conversation(spark):
    """100,000 rows, 300 KB texts among them: one shuffle by conversation, and the audit is as long as it must be."""
    n = 100_000
    rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.repeat(F.lit("x"), F.when(F.col("id") % 20_000 == 0, 300_000).otherwise(1)), F.col("id").cast("string"), F.lit(".")).alias("text"))
    steps = repair.repair(rows)
    plan = steps._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "NestedLoop" not in plan
    assert {(x.edit, x["count"]) for x in steps.groupBy("edit").count().collect()} == {("K", n)}


def test_empty_and_clashing_names(spark):
    assert repair.op11(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = spark.createDataFrame([(1, 0, "user", "a."), (1, 0, "user", "a."), (None, None, None, None)], SCHEMA)
    wide = rows.select("*", *(F.lit(1).alias(c) for c in "d seen fault before behind step edit was cost copy found every gaps audit".split()))
    assert sorted(map(str, repair.op11(wide).collect())) == sorted(map(str, repair.op11(rows).collect()))
