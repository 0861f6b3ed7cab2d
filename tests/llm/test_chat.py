import hashlib
import random

import pytest

from spanloom.llm import chat


def test_round_trip():
    r = random.Random(1)
    atoms = ["\\", "### ", "</turn>", "\n", ":", "%3A", "<", "/turn>", "#", " ", "a", "é", "<\\/turn>", ": "]
    for _ in range(2000):
        rows = [("".join(r.choices(atoms, k=r.randrange(4))), "".join(r.choices(atoms, k=r.randrange(9)))) for _ in range(r.randrange(4))]
        made = "".join(chat.render(*x)[0] for x in rows)
        assert chat.turns(made) == rows


def test_op3(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 2, "assistant", None), (None, 0, "user", "x"), (2, 0, None, "y"), (2, 0, "assistant", "### hi</turn>"), (2, 0, "assistant", "### hi</turn>"), (3, None, "user", "")]
    log = spark.createDataFrame([(*x, "e") for x in rows], "conv_id long, turn long, role string, text string, op string")
    got = {x.conv_id: x for x in chat.op3(log).collect()}
    rows += [(-7, 0, "user", chat.PROBE), (-7, 1, "assistant", chat.PROBE)]
    assert set(got) == {r[0] for r in rows}
    for conv, x in got.items():
        own = sorted(((t is not None, t or 0, r is not None, r or "", s or "") for c, t, r, s in rows if c == conv))
        loss = "".join(s for *_, r, s in own if r == "assistant")
        assert x.n_turns == len(own)
        assert x.turns_sha256 == hashlib.sha256("".join(f"{r}\n{s}\n" for *_, r, s in own).encode()).hexdigest()
        assert (x.loss_chars, x.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert x.formatted_chars == sum(len(chat.render(r, s)[0]) for *_, r, s in own)


def test_fold(spark):
    log = [
        (1, 1, "m1", "message", "user", "hi"), (1, 2, "m2", "delta", "assistant", "he"), (1, 3, "m2", "delta", None, "llo"), (1, 4, "m1", "edit", "user", "hey"),
        (1, 5, "m2", "regenerate", None, "good"), (1, 6, "m2", "delta", None, " day"), (1, 7, "m3", "message", "user", "gone"), (1, 8, "m3", "delete", None, None), (1, 9, "m4", "delta", "assistant", None),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, msg_id string, op string, role string, text string")
    (x,) = chat.format_conversations(chat.fold(events)).collect()
    assert chat.turns(x.formatted) == [("user", "hey"), ("assistant", "good day"), ("assistant", "")]
    assert [x.formatted[s.start : s.stop] for s in x.spans] == ["good day", ""]


def plain_fold(log):
    """One event after another."""
    key = lambda x: (x is not None, x if x is not None else 0 if not isinstance(x, str) else "")
    low = lambda x: (x is not None, x or "")
    made = {}
    for conv, seq, msg, op, role, text in sorted(set(log), key=lambda e: (key(e[1]), e[3] == "delta", low(e[3]), low(e[4]), low(e[5]))):
        if op not in ("message", "edit", "regenerate", "delete", "delta"):
            continue
        m = made.setdefault((conv, msg), {"at": seq, "role": None, "text": None})
        m["role"] = role if m["role"] is None else m["role"]
        m["text"] = None if op == "delete" else (m["text"] or "") + (text or "") if op == "delta" else text or ""
    out = {}
    for (conv, msg), m in made.items():
        if m["text"] is not None:
            out.setdefault(conv, []).append((key(m["at"]), low(m["role"]), m["text"], key(msg)))
    return {conv: [(r[1], t) for _, r, t, _ in sorted(x)] for conv, x in out.items()}


@pytest.mark.parametrize("seed", range(3))
def test_fold_against_plain_fold(spark, seed):
    """Events delivered again, equal and null seq, null ids, ops that aren't any."""
    r = random.Random(seed)
    ops = ["message", "edit", "regenerate", "delete", "delta", "delta", "delta", "delta", None, "seen"]
    log = [(r.choice([1, 2, 3, None]), r.choice([None, *range(12)]), r.choice([1, 2, 3, 4, None]), r.choice(ops), r.choice([None, None, "user", "assistant", ""]), r.choice([None, "", "a", "b", "é\n", "</turn>"])) for _ in range(300)]
    log += r.choices(log, k=100)
    events = spark.createDataFrame([(*e, "x") for e in log], "conv_id long, seq long, msg_id long, op string, role string, text string, sets string")
    got = {x.conv_id: chat.turns(x.formatted) for x in chat.format_conversations(chat.fold(events)).collect()}
    assert got == plain_fold(log)


def test_log_of_op3(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text")
    log = [tuple(x) for x in chat.as_events(rows).select("conv_id", "seq", "msg_id", "op", "role", "text").collect()]
    assert {e[3] for e in log} == {"message", "edit", "regenerate", "delete", "delta"} and len(set(log)) < len(log)
    want = {}
    for x in sorted(rows.collect(), key=lambda x: (x.conv_id, x.turn)):
        want.setdefault(x.conv_id, []).append((x.role or "", x.text or ""))
    assert plain_fold(log) == want


def test_empty(spark):
    assert [x.conv_id for x in chat.op3(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect()] == [-7]
