import math
import random
import zlib

import numpy as np
import pytest

from spanloom.llm import toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, last = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(last[j + 1] + 1, row[j] + 1, last[j] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("seed", range(5))
def test_automaton_against_all_distances(seed):
    r = random.Random(seed)
    say = lambda a, b: "".join(r.choices("abc", k=r.randrange(a, b)))
    terms = list(dict.fromkeys(say(3, 8) for _ in range(12)))
    automaton = toxicity.Automaton(terms)
    for _ in range(500):
        word = say(1, 9)
        near = [(distance(word, t), k) for k, t in enumerate(terms)]
        near = [x for x in near if x[0] == 0 or x[0] == 1 and len(terms[x[1]]) >= toxicity.ONE_EDIT_FROM]
        assert automaton.find(word) == ((min(near)[1], min(near)[0]) if near else None)


def fixture(n=800):
    r = random.Random(5)
    words = [f"{a}{b}" for a in "ba ne ro ti lu".split() for b in "dax mon pel gor sef".split()]
    rows, labels = [], []
    for d in range(n):
        text, toxic = r.choices(words, k=40), d % 8 == 0
        if toxic:
            bad = r.choice(["moronic", "scumbag"])
            text[r.randrange(40)] = bad if d % 3 else bad[:3] + "x" + bad[4:]
        elif d % 8 == 1:
            text[10:13] = ["said", '"moronic"', "word"]
        rows.append((d, " ".join(text)))
        if d % 5:
            labels.append((d, int(toxic)))
    return rows, labels


def test_held_out(spark):
    rows, labels = fixture()
    docs = spark.createDataFrame([*((*x, 1) for x in rows), (None, None, 1), (900, "", 1), (0, rows[0][1], 1)], "doc_id long, text string, toxic int")
    marks = spark.createDataFrame([*labels, (None, 1), (3, None), (labels[0][0], 0)], "doc_id long, toxic int")
    got = toxicity.op4(docs, marks).collect()
    assert len(got) == len(rows) + 3 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in got)
    held = [(x.predicted, x.doc_id % 8 == 0) for x in got if x.held_out and x.doc_id is not None and x.doc_id < 800]
    assert len(held) > 100 and sum(a != b for a, b in held) <= 2
    assert not any(x.predicted for x in got if x.doc_id in (None, 900))


def brute_features(text, terms, weights):
    def best(word):
        bare = word.strip(toxicity.STRIP)
        near = [(distance(bare, t), k) for k, t in enumerate(terms) if abs(len(bare) - len(t)) < 2]
        near = [x for x in near if x[0] == 0 or x[0] == 1 and len(terms[x[1]]) >= toxicity.ONE_EDIT_FROM]
        return min(near, default=None)

    words = (text or "").lower().split()
    direct = misspelled = quoted = addressed = hits = 0
    seen = set()
    for k, word in enumerate(words):
        if (hit := best(word)) is None:
            continue
        near = words[max(0, k - toxicity.NEAR) : k + toxicity.NEAR + 1]
        marks = [any(q in w for q in toxicity.QUOTES) for w in near]
        if any(q in word for q in toxicity.QUOTES) or sum(marks) > 1 or any(w in toxicity.REPORTS for w in near):
            quoted += weights[hit[1]]
        elif hit[0]:
            misspelled += weights[hit[1]]
        else:
            direct += weights[hit[1]]
        addressed += weights[hit[1]] * any(w in toxicity.ADDRESSES for w in near)
        seen.add(hit[1])
        hits += 1
    sums = [math.log1p(x) for x in (direct, misspelled, quoted, addressed)]
    return [*sums, math.log1p(len(seen)), min(1.0, 10 * hits / len(words)) if words else 0.0]


def brute_lexicon(sample):
    """sample: (toxic, text). Words by G-test, of toxic documents that stand before unlike words."""
    split = [(y, [w.strip(toxicity.STRIP) for w in t.lower().split()]) for y, t in sample]
    n1, n = sum(y for y, _ in sample), len(sample)
    out = []
    for word in {w for _, ws in split for w in ws if 3 <= len(w) <= 40}:
        a, b = sum(y and word in ws for y, ws in split), sum(not y and word in ws for y, ws in split)
        table = [(a, (a + b) * n1 / n), (b, (a + b) * (n - n1) / n), (n1 - a, (n - a - b) * n1 / n), (n - n1 - b, (n - a - b) * (n - n1) / n)]
        g = 2 * sum(x * math.log(x / e) for x, e in table if x)
        weight = math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n - n1 + 1))
        after = {ws[k + 1] if k + 1 < len(ws) else None for y, ws in split if y for k, w in enumerate(ws) if w == word} - {None}
        if a >= 3 and g >= toxicity.LEAST_G and weight >= 1 and len(after) >= min(0.6 * a, toxicity.CONTEXTS):
            out.append((-g, word, weight))
    return [(w, x) for _, w, x in sorted(out)]


def test_op4_against_brute_force(spark):
    """Lexicon, features, fit and scores; words with no-break and ideographic spaces between them, very long words."""
    rows, labels = fixture()
    rows += [(801, "you\u00a0scumbag\u3000x"), (802, "moronic" * 40_000), (803, "x" * 300_000 + " moronic, you"), (804, "“moronic” he wrote"), (805, "mo moroni moronicc scumbags SCUMBAG!"), (806, "\u0085scumbag")]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    sample = [(y, rows[d][1]) for d, y in labels if zlib.crc32(str(d).encode()) % 4 != 2]
    terms, weights, fitted = toxicity.learn(docs, marks)
    want = brute_lexicon(sample)
    assert terms == [w for w, _ in want] and np.allclose(weights, [x for _, x in want]) and {"morxnic", "scumbag"} <= set(terms)
    x, y = np.array([brute_features(t, terms, weights) for _, t in sample]), np.array([y for y, _ in sample])
    p = 1 / (1 + np.exp(-(x @ fitted[:-1] + fitted[-1])))  # all labelled documents are drawn, so the constant isn't moved
    assert np.abs(x.T @ (p - y) + fitted[:-1]).max() < 1e-5 and abs((p - y).sum() + 1e-3 * fitted[-1]) < 1e-5
    got = {x.doc_id: x.score for x in toxicity.op4(docs, marks).collect()}
    for d, t in rows:
        f = [0.0] * 6 if d in (802,) else brute_features(t, terms, weights)
        assert got[d] == pytest.approx(1 / (1 + math.exp(-(np.dot(f, fitted[:-1]) + fitted[-1]))), abs=1e-9), d


def test_automaton_made_anew(monkeypatch):
    monkeypatch.setattr(toxicity, "KNOWN_STATES", 5)
    test_automaton_against_all_distances(1)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [x.score for x in toxicity.op4(docs, none).collect()] == [0.0]
    assert toxicity.op4(docs.limit(0), spark.createDataFrame([(1, 1), (2, 0)], none.schema)).collect() == []
