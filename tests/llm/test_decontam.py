import hashlib
import random
import re

import numpy as np
import pytest

from spanloom.llm import decontam
from spanloom.llm.fmindex import FMIndex, suffix_array

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add((i is None, "" if i is None else str(i)))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= x
        sha = hashlib.sha256(",".join(sorted(i for _, i in found)).encode()).hexdigest()
        out.append((d is None, d or 0, len(w), len(hit), len(found), sha, bool(hit)))
    return sorted(out)


def fixture():
    r = random.Random(1)
    vocabulary = ["a", "B", "Café", "ß9", "x1", "the", "Über", "longer_than", "w" * 30, "7"]
    say = lambda n: " ".join(r.choices(vocabulary, k=n))
    items = [(k, say(r.choice([0, 1, 3, 9, 10, 11, 40]))) for k in range(6, 20)]
    items += [(20, items[-1][1]), (None, say(12)), ("", say(13)), (21, None), (22, "?!")]
    docs = []
    for k in range(120):
        text = say(r.choice([0, 5, 60, 300]))
        if r.random() < 0.4:
            text += " -- " + (r.choice(items)[1] or "") + ". " + say(4)
        docs.append((k, text))
    docs += [(None, docs[5][1]), (5, docs[5][1]), (200, None), (201, ""), (202, (items[0][1] or "q") * 3)]
    return docs, items


def test_against_brute_force(spark, monkeypatch):
    docs, items = fixture()
    items = [x for x in items if x[1] is None or len(words(x[1])) != 1]
    d = spark.createDataFrame([(*x, "z") for x in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(None if i is None else str(i), t) for i, t in items], "item_id string, text string")
    want = brute(docs, items)
    whole = decontam.searched
    for size, many in ((decontam.BLOCK_BYTES, 16), (300, 100), (300, 2)):
        monkeypatch.setattr(decontam, "searched", lambda x, y, s=size, m=many: whole(x, y, s, m))
        got = sorted((x.doc_id is None, x.doc_id or 0, x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in decontam.op6(d, b).collect())
        assert got == want


@pytest.mark.parametrize("many", [16, 1])
def test_removal(spark, monkeypatch, many):
    whole = decontam.searched
    monkeypatch.setattr(decontam, "searched", lambda x, y: whole(x, y, 40, many))

    b = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "not there"), (3, "nor this")], "item_id long, text string")
    d = spark.createDataFrame([(1, "Keep é ONE two three four five six seven eight nine ten, eleven! end", 5), (2, "clean", 9), (3, None, None)], "doc_id long, text string, n_chars long")
    got = {x.doc_id: (x.text, x.n_chars) for x in decontam.remove(d, b).collect()}
    assert got == {1: ("Keep é ! end", 12), 2: ("clean", 9), 3: (None, None)}


def test_words_made_to_collide(spark):
    """Words whose polynomial hashes, sizes and first bytes agree."""
    thue = lambda n, swap: "q" * 16 + "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))
    say = "one two three four five six seven eight nine "
    for n in (1024, 2048):
        items = [(1, say + thue(n, 0)), (2, say + "ten " + thue(n, 1) + " " + thue(n, 0))]
        docs = [(1, say + thue(n, 0)), (2, say + thue(n, 1)), (3, say + "ten"), (4, f"two three four five six seven eight nine ten {thue(n, 1)}"), (5, f"two three four five six seven eight nine ten {thue(n, 0)}")]
        d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
        got = sorted((False, *x) for x in decontam.op6(d, b).collect())
        assert got == brute(docs, items) and [x[-1] for x in got] == [True, False, True, True, False]


def test_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [tuple(x)[:4] for x in decontam.op6(d, none).collect()] == [(1, 2, 0, 0)]
    assert decontam.op6(d.limit(0), none).collect() == []


def test_index():
    r = np.random.default_rng(2)
    for _ in range(30):
        s = r.integers(0, 4, r.integers(1, 200))
        s[-1] = 0
        unlike = np.where(s == 0, np.cumsum(s == 0) - 1, s + (s == 0).sum())
        assert suffix_array(unlike).tolist() == sorted(range(len(s)), key=lambda i: unlike[i:].tolist())
        index = FMIndex(s, 5)
        for n in (1, 2, 3):
            patterns = r.integers(1, 5, (20, n))
            low, high = index.search(patterns)
            for p, a, b in zip(patterns, low, high):
                want = [i for i in range(len(s) - n + 1) if (s[i : i + n] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want
