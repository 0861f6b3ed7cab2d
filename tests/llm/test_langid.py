import math
import random
import zlib

import numpy as np
import pytest

from spanloom.llm import langid


def fixture(n=400):
    r = random.Random(1)
    kinds = {"aa": ["the", "tion", "ing", "house"], "bb": ["ção", "não", "muito", "lhe"], "cc": ["sch", "über", "ung", "keit"]}
    say = lambda k, m: " ".join("".join(r.choices(kinds[k], k=2)) for _ in range(m))
    rows = [(d, say(k := r.choice("aa bb cc".split()), r.choice([3, 30, 200])), k) for d in range(n)]
    rows += [(n, None, "aa"), (n + 1, "", "aa"), (n + 2, "123 !!", "bb"), (None, say("bb", 30), None), (n + 3, say("aa", 70) + " " + say("cc", 30), None), (n + 4, "日本", None)]
    return rows


def test_held_out_accuracy(spark):
    rows = fixture()
    docs = spark.createDataFrame([(*x, 0.5) for x in rows], "doc_id long, text string, lang string, score double")
    got = {x.doc_id: x for x in langid.op9(docs).collect()}
    assert len(got) == len(rows)
    for d, t, lang in rows:
        if d is not None:
            assert got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0)
    tested = [(got[d].lang_pred, lang) for d, t, lang in rows if d is not None and got[d].held_out and lang and t and len(t) > 5]
    assert len(tested) > 50 and all(a == b for a, b in tested)
    assert [got[k].lang_pred for k in (400, 401, 402)] == ["und"] * 3
    assert got[None].lang_pred == "bb" and not got[None].held_out
    assert got[403].lang_pred == "aa" and 0.55 < got[403].score < 0.85
    assert got[404].lang_pred in ("aa", "bb", "cc")


def brute_proportions(text, logs):
    """One text: the mixture by expectation-maximisation over pieces of 64 bytes, languages struck out from the weakest on."""
    data = text.encode()
    low = [c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in data]
    gram = lambda k: ((((low[k - 1] if k else 32) << 16 | low[k] << 8 | (low[k + 1] if k + 1 < len(low) else 32)) * 2654435761) % 2**32) >> 16
    pieces = [[sum(float(logs[j][gram(k)]) for k in range(a, min(a + 64, len(low)))) for j in range(len(logs))] for a in range(0, len(low), 64)]
    likely = [[math.exp(max(x - max(row), -500)) for x in row] for row in pieces]

    def fit(pi, rounds):
        for _ in range(rounds):
            parts = [[w * x for w, x in zip(pi, row)] for row in likely]
            pi = [sum(row[j] / sum(row) for row in parts) / len(parts) for j in range(len(pi))]
        return pi, sum(math.log(sum(w * x for w, x in zip(pi, row))) for row in likely)

    pi, best = fit([1 / len(logs)] * len(logs), 10)
    while sum(x > 0 for x in pi) > 1:
        weakest = -min((x, -j) for j, x in enumerate(pi) if x > 0)[1]
        rest = [0 if j == weakest else x for j, x in enumerate(pi)]
        if sum(rest) <= 1e-12:
            break
        fewer, less = fit([x / sum(rest) for x in rest], 5)
        if best - less >= 0.5 * math.log(len(pieces)) + 2:
            break
        pi, best = fewer, less
    return pi


def test_proportions_against_brute_force(spark):
    rows = fixture(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, table = langid.learn(docs)
    counts = np.full((3, langid.TABLE), 0.5)
    for d, t, lang in rows:
        if d is not None and lang and t and zlib.crc32(str(d).encode()) % 5:
            raw = np.frombuffer(t.encode(), np.uint8)
            np.add.at(counts[names.index(lang)], langid.trigrams(raw, np.array([0, len(raw)])), 1)
    assert names == ["aa", "bb", "cc"] and np.allclose(table, np.log(counts / counts.sum(1, keepdims=True)), atol=1e-5)
    texts = [t for _, t, _ in rows if t] + ["the tion " * 40 + "ção não " * 40, "über " * 10 + "the " * 100, "x", "日本 " * 3000, "the" * 50_000]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    got = langid.proportions(raw, offsets, table)
    for t, pi in zip(texts, got):
        assert pi == pytest.approx(brute_proportions(t, table), abs=1e-6)


def test_many_languages_share_the_table(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_ENTRIES", 1 << 17)
    names, table = langid.learn(spark.createDataFrame(fixture(), "doc_id long, text string, lang string"))
    assert table.shape == (3, 1 << 15)
    monkeypatch.setattr(langid, "TABLE", 1 << 15)
    test_held_out_accuracy(spark)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.op9(docs).collect() == []
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [x.lang_pred for x in langid.op9(docs).collect()] == ["und"]


def test_many_languages(monkeypatch):
    """Forty languages: a text's set is found whatever the tiles, one with more languages than are kept at first included; and all languages at once give the same sets."""
    r = random.Random(5)
    words = [["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)] for _ in range(40)]
    say = lambda k, m: " ".join(r.choices(words[k], k=m)) + " "
    table = np.full((40, langid.TABLE), 0.5)
    for k in range(40):
        raw = np.frombuffer(say(k, 4000).encode(), np.uint8)
        np.add.at(table[k], langid.trigrams(raw, np.array([0, len(raw)])), 1)
    table = np.log(table / table.sum(1, keepdims=True)).astype(np.float32)
    sets = [{3}, {39}, {0, 17}, set(range(5, 17)), {21}, set(range(20)), {8, 9, 10}]
    texts = ["".join(say(k, 120) for k in sorted(x)) for x in sets]
    raw, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    want = langid.proportions(raw, offsets, table)
    assert [set(np.flatnonzero(pi > 0.01).tolist()) for pi in want] == sets
    assert np.allclose(want.sum(1), 1)
    for tile in (40, 1000, 1 << 14):
        monkeypatch.setattr(langid, "TILE", tile)
        assert np.allclose(langid.proportions(raw, offsets, table), want, atol=1e-6)
    monkeypatch.setattr(langid, "KEPT", 40)
    assert np.allclose(langid.proportions(raw, offsets, table), want, atol=0.01)


def test_ties():
    """Of languages that are alike the first by name stays, however many there are."""
    r = np.random.default_rng(1)
    one, other = (np.log(r.dirichlet(np.full(langid.TABLE, 0.1)) + 1e-9).astype(np.float32) for _ in range(2))
    raw = np.frombuffer(b"some words of a text " * 30, np.uint8)
    for table, want in (([one, one], 0), ([one] * 5, 0), ([one] * 30, 0)):
        assert np.flatnonzero(langid.proportions(raw, np.array([0, len(raw)]), np.stack(table))[0]).tolist() == [want]
    better, worse = (one, other) if one[langid.trigrams(raw, np.array([0, len(raw)]))].sum() > other[langid.trigrams(raw, np.array([0, len(raw)]))].sum() else (other, one)
    for n in (1, 20):
        got = langid.proportions(raw, np.array([0, len(raw)]), np.stack([worse] * n + [better] * n))[0]
        assert got.argmax() == n
