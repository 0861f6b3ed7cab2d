"""Conversation structure repair: the cheapest edits that give a conversation a legal order of roles.

Between rows stand nodes (row, state of the pattern's automaton); arcs are edits: K keeps a row (0), R gives it the role user or
assistant (1), D deletes it (2; the only one for blank and duplicate rows), I inserts an empty text of user or assistant (5; stays at its row).
A truncated row that isn't deleted costs 5 more. Two streams go along the sorted rows of a conversation. Backwards: the least
cost from each state to the end, set down beside the row. Forwards: the least cost from the start; an arc is tight if forward cost,
arc and backward cost add up to the cheapest repair, and of the tight arcs that leave the frontier, a set of states, those with
the least letter are followed, all of them. So the edits are the ASCII-least of all cheapest ones. Both streams hold a few numbers a
state, however long a conversation is; rows are dealt by conversation once, and the sorts between the streams may spill. A conversation
is one task's, since its digest is one sequential pass over its texts.

Rows: by turn (nulls first), then role, text; rows repeated whole stay adjacent, and the first one isn't a duplicate. Null role,
text: one space, as in the damage's key. A null conv_id is one conversation. A role's initial is its first character, whatever follows; an
empty role has none. Very long texts: whole. Other columns aren't read. Empty table: empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
SPACE = " \t\n\x0b\x0c\r"
ROLES = ("user", "assistant")
REROLE, DELETE, INSERT, CUT_SHORT = 1, 2, 5, 5
#: The automaton of (s?(ua)+)?: start, after s, after u, after a.
START, STATES = 0, range(4)
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
NEVER = 1 << 60
#: Insertions (from, to, role): they stay at their row.
INSERTS = [(q, MOVES[q, r[0]], r) for q in STATES for r in ROLES if (q, r[0]) in MOVES]

Arc = tuple[str, int, int, int, str | None]


def arcs(initial: str, fault: str | None) -> list[Arc]:
    """(letter, from, to, cost, new role) of the edits of one row."""
    out: list[Arc] = [("D", q, q, DELETE, None) for q in STATES]
    if fault in (BLANK, DUPLICATE):
        return out
    more = CUT_SHORT if fault == TRUNCATED else 0
    out += [("K", q, MOVES[q, initial], more, None) for q in STATES if (q, initial) in MOVES]
    return out + [("R", q, to, REROLE + more, r) for q, to, r in INSERTS]


def _to_end(costs: list[int]) -> list[int]:
    """Costs to the end before insertions are made, given those after."""
    for _ in STATES:
        for q, to, _role in INSERTS:
            costs[q] = min(costs[q], costs[to] + INSERT)
    return costs


#: From each state to the end, where no row is left.
LAST = _to_end([0 if q in ENDS else NEVER for q in STATES])


def before(after: list[int], edits: list[Arc]) -> list[int]:
    """The least costs to the end before a row, from those after it."""
    costs = [NEVER] * len(STATES)
    for _, q, to, cost, _role in edits:
        costs[q] = min(costs[q], after[to] + cost)
    return _to_end(costs)


class Walk:
    """Forward costs and the frontier along one conversation's rows."""

    def __init__(self, total: int):
        self.total = total
        self.costs = [0 if q == START else NEVER for q in STATES]
        self.frontier = {START}

    def _insert(self, to_end: list[int], edits: list[Arc]) -> Iterator[str]:
        """Insertions at this place, as long as I is the least letter of a tight arc; forward costs of all states are brought up to it."""
        costs = self.costs
        for _ in STATES:
            for q, to, _role in INSERTS:
                costs[to] = min(costs[to], costs[q] + INSERT)
        while True:
            if any(letter < "I" and q in self.frontier and costs[q] + cost + after == self.total for letter, q, cost, after in edits):
                return
            tight = [(to, role) for q, to, role in INSERTS if q in self.frontier and costs[q] + INSERT + to_end[to] == self.total]
            if not tight or not edits and any(q in ENDS and costs[q] == self.total for q in self.frontier):
                return
            self.frontier = {to for to, _ in tight}
            yield tight[0][1]

    def row(self, to_end: list[int], after: list[int], edits: list[Arc]) -> tuple[list[str], str, str | None]:
        """Roles inserted before a row, the row's letter, and its new role if it has one. to_end, after: costs to the end before and behind the row."""
        inserted = list(self._insert(to_end, [(letter, q, cost, after[to]) for letter, q, to, cost, _ in edits]))
        tight = [(letter, to, role) for letter, q, to, cost, role in edits if q in self.frontier and self.costs[q] + cost + after[to] == self.total]
        letter = min(x[0] for x in tight)
        role = next(x[2] for x in tight if x[0] == letter)
        self.frontier = {to for x, to, _ in tight if x == letter}
        costs = [NEVER] * len(STATES)
        for _, q, to, cost, _role in edits:
            costs[to] = min(costs[to], self.costs[q] + cost)
        self.costs = costs
        return inserted, letter, role

    def end(self) -> list[str]:
        return list(self._insert(LAST, []))


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after rows are dropped, emptied, cut short, repeated or given to the user, by a checksum of conversation and turn."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), word("role").alias("role"), word("text").alias("text"))
    rows = rows.withColumn("d", F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20).where("d <> 0")
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _fault(seen: Column) -> Column:
    body = F.rtrim("text", F.lit(SPACE))
    return F.when(body == "", BLANK).when(seen > 1, DUPLICATE).when(~F.right(body, F.lit(1)).isin(".", "!", "?"), TRUNCATED)


def _backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (conv_id, turn, role, text, seen, fault) of conversations from their last row to the first: the costs to the end before and behind each."""
    conv, costs = None, None
    for batch in batches:
        made, behind = [], []
        for c, role, fault in zip(*(batch.column(k).to_pylist() for k in (0, 2, 5)), strict=True):
            if costs is None or c != conv:
                conv, costs = c, LAST
            behind.append(costs)
            costs = before(costs, arcs(role[:1], fault))
            made.append(costs)
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, kind), pa.array(behind, kind)], [*batch.schema.names, "before", "behind"])


STEPS = "conv_id long, step long, edit string, turn long, was string, role string, text string, fault string, cost long"
STEP_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())


def _forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over the same rows in order: a row for each edit."""
    conv, walk, step = None, None, 0

    def out(steps: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*steps, strict=True), STEP_TYPES, strict=True)], [x.split()[0] for x in STEPS.split(", ")])

    def inserts(roles: list[str]) -> list[tuple]:
        nonlocal step
        step += len(roles)
        return [(conv, step - len(roles) + k, "I", None, None, r, "", None, INSERT) for k, r in enumerate(roles)]

    for batch in batches:
        steps: list[tuple] = []
        for c, turn, role, text, _, fault, to_end, behind in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if walk is None or c != conv:
                if walk is not None:
                    steps += inserts(walk.end())
                conv, walk, step = c, Walk(to_end[START]), 0
            edits = arcs(role[:1], fault)
            inserted, letter, new = walk.row(to_end, behind, edits)
            steps += inserts(inserted)
            cost = {"D": DELETE, "K": 0, "R": REROLE}[letter] + (CUT_SHORT if fault == TRUNCATED and letter != "D" else 0)
            steps.append((c, step, letter, turn, role, None if letter == "D" else new or role, text, fault, cost))
            step += 1
        if steps:
            yield out(steps)
    if walk is not None and (steps := inserts(walk.end())):
        yield out(steps)


def repair(rows: DataFrame) -> DataFrame:
    """rows: (conv_id, turn, role, text). Each conversation's edits in order, a row each: the letter, the row's turn and former role (null if inserted), the
    new role (null if deleted), the text, the fault and the cost. The repaired conversation is what has a role. Rows of a conversation lie in order in one partition."""
    spaced = [F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")]
    dealt = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *spaced).repartition("conv_id")
    seen = dealt.withColumn("seen", F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("turn")))
    seen = seen.withColumn("fault", _fault(F.col("seen")))
    down = seen.sortWithinPartitions("conv_id", *(F.desc_nulls_last(c) for c in ("turn", "role", "text", "seen")))
    costed = down.mapInArrow(_backwards, "conv_id long, turn long, role string, text string, seen int, fault string, before array<long>, behind array<long>")
    return costed.sortWithinPartitions("conv_id", "turn", "role", "text", "seen").mapInArrow(_forwards, STEPS)


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Totals:
    def __init__(self, conv):
        self.conv, self.low, self.last, self.turns = conv, None, None, 0
        self.faults = {BLANK: 0, DUPLICATE: 0, TRUNCATED: 0}
        self.illegal = self.cost = 0
        self.initial: str | None = None
        self.audit = bytearray()
        self.digest, self.joined = hashlib.sha256(), False

    def add(self, edit, turn, was, role, text, fault, cost):
        self.audit += edit.encode()
        self.cost += cost
        if edit != "I":
            if turn is not None and turn != self.last:
                self.low = turn if self.low is None else self.low
                self.last = turn
                self.turns += 1
            if fault:
                self.faults[fault] += 1
            self.illegal += self.initial is not None and self.initial + was[:1] not in ("su", "ua", "au")
            self.initial = was[:1]
        if role is not None:
            self.digest.update(("\n" * self.joined + f"{role}:{text}").encode())
            self.joined = True

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.last - self.low + 1 - self.turns
        return (self.conv, gaps, *self.faults.values(), self.illegal, self.cost, self.audit.decode(), self.digest.hexdigest())


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SUMMARY.split(", ")]
    types = [pa.int64()] * 7 + [pa.string()] * 2
    held: _Totals | None = None
    for batch in batches:
        done = []
        for conv, _, *step in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held is None or conv != held.conv:
                if held is not None:
                    done.append(held.row())
                held = _Totals(conv)
            held.add(*step)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(held.row(), types, strict=True)], names)


def op11(conversations: DataFrame) -> DataFrame:
    found = repair(damage(conversations)).mapInArrow(_summed, SUMMARY).withColumnRenamed("conv_id", "found")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    joined = every.join(found, every.conv_id.eqNullSafe(found.found), "left")
    sums = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *sums, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def oracle_sql() -> str:
    """The cheapest edits with the least letters by a forward recursion whose states hold cost, letters and repaired text."""

    def then(state: str, cost: str, letter: str, text: str) -> str:
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'r': {state}.r || {text}}}"

    def least(*options: str) -> str:
        return f"list_min([{', '.join(options)}])"

    user, assistant, kept = "chr(10) || 'user:'", "chr(10) || 'assistant:'", "chr(10) || role || ':' || text"
    more = "(CASE fault WHEN 'truncated' THEN 5 ELSE 0 END)"
    keep = lambda of, initial: f"CASE WHEN fault NOT IN ('blank', 'duplicate') AND left(role, 1) = '{initial}' THEN {then(of, more, 'K', kept)} END"
    rerole = lambda of, name: f"CASE WHEN fault NOT IN ('blank', 'duplicate') THEN {then(of, f'1 + {more}', 'R', f'{name} || text')} END"
    with_u = least("u", *(then(q, "5", "I", user) for q in ("z", "s", "a")))
    with_a = least("a", then("ui", "5", "I", assistant))
    none = "{'c': CAST(1000000000000 AS BIGINT), 'a': '', 'r': ''}"
    return rf"""
WITH RECURSIVE o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda ch: ascii(ch))),
      lambda v, b: list_reduce(list_prepend(xor(v, b), range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS d
  FROM conversations),
m AS (
  SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE d WHEN 3 THEN [0, 1] ELSE [0] END) AS twice
  FROM o WHERE d <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM m),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM n),
f AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM s),
w AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 'r': ''}} AS z, {none} AS s, {none} AS u, {none} AS a FROM (SELECT DISTINCT conv_id FROM f)
  UNION ALL
  SELECT conv_id, i, {then('z', '2', 'D', "''")},
    {least(then('s', '2', 'D', "''"), keep('z', 's'))},
    {least(then('ui', '2', 'D', "''"), *(g(q, x) for q in ('z', 's', 'ai') for g, x in ((keep, 'u'), (rerole, user))))},
    {least(then('ai', '2', 'D', "''"), keep('ui', 'a'), rerole('ui', assistant))}
  FROM (SELECT *, {with_a} AS ai FROM (
    SELECT f.conv_id, f.i, f.role, f.text, f.fault, z, s, u, a, {with_u} AS ui FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1))),
e AS (
  SELECT conv_id, {least('z', with_a)} AS x
  FROM (SELECT conv_id, z, s, u, a, {with_u} AS ui FROM w QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)),
g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id)
SELECT k.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(x.c, 0) AS BIGINT) AS cost, coalesce(x.a, '') AS audit,
  sha256(coalesce(substr(x.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM k.conv_id
"""
