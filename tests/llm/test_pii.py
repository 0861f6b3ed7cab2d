import hashlib
import random
import re

import pytest

from spanloom.llm import pii

BASE = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(text):
    out = []
    for k, pattern in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 14 <= len(d) <= 19 and luhn(d) or k == 3 and 10 <= len(d) <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@pytest.mark.parametrize("seed", range(8))
def test_base_spans(seed):
    r = random.Random(seed)
    atoms = ["a", "b.c", "@", "@", "x-y", ".", "..", " ", "é", "+1", "(743)", "555-1055", "4381893557741609", "10.0.0.1", "256.1.1.1", "0", "7", "-", "_", "4716-9385", "1.2.3", "001.002.003.4"]
    for _ in range(400):
        text = "".join(r.choices(atoms, k=r.randrange(25)))
        assert pii.base_spans(text) == brute(text), text


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" + "(" * 200_000, "a@" * 50_000):
        pii.base_spans(text)


def fixture():
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefgh", k=7))
    rows = []
    for k in range(300):
        words = ["the", *(word() for _ in range(40))]
        if k % 10 == 0:  # one person's address, always near the same surname
            words[21:21] = ["Quillfeather", "joe.q@example.org", "the", "common"]
        elif k % 10 == 1:
            words[5:5] = ["common", "+1 (743) 555-3824"]
        elif k % 10 == 2:
            words[3:3] = ["common"]
        rows.append((k, " ".join(words)))
    return rows + [(None, rows[0][1]), (0, rows[0][1]), (400, None), (401, ""), (402, "mail joe.q@example.org")]


def test_op8(spark):
    rows = fixture()
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, tie string")
    got = sorted(((x.doc_id is None, x.doc_id or 0), tuple(x[1:6]), x.spans) for x in pii.op8(docs).collect())
    want = []
    for d, t in rows:
        spans = brute(t)
        extra = [(m.start(), 5, m.end()) for m in re.finditer("Quillfeather", t or "")] if spans else []
        counts = tuple(sum(k == n for _, k, _ in spans) for n in range(4))
        want.append(((d is None, d or 0), (*counts, hashlib.sha256(pii.joined(spans).encode()).hexdigest()), pii.joined(sorted(spans + extra))))
    assert got == sorted(want)
    assert all(x.n_spans == len(x.spans.split(",")) * bool(x.spans) for x in pii.op8(docs).collect())


def test_sanitise(spark):
    rows = fixture()
    docs = spark.createDataFrame([(d, t, None if t is None else len(t)) for d, t in rows], "doc_id long, text string, n_chars long")
    made = pii.sanitise(docs)
    assert made.schema == docs.schema
    got = made.collect()
    assert len(got) == len(rows)
    assert not any(brute(x.text) or "Quillfeather" in (x.text or "") for x in got)
    assert all(x.n_chars == (None if x.text is None else len(x.text)) for x in got)
    texts = {t for _, t in rows}
    assert sum(x.text in texts for x in got) == sum(not brute(t) for _, t in rows)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.op8(docs).collect() == [] and pii.sanitise(docs).collect() == []


def test_terms_far_from_the_match(spark):
    """A surname a paragraph from the address, and in a document without it; words of copies of one passage stay."""
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefgh", k=7))
    rows = []
    for k in range(200):
        words = [word() for _ in range(150)]
        if k % 20 == 0:
            words[10:10], words[130:130] = ["joe.q@example.org"], ["Quillfeather"]
        rows.append((k, " ".join(words)))
    rows.append((200, f"{rows[1][1]} Quillfeather {rows[2][1]}"))
    passage = f"{word()} {word()} {word()} {word()} {word()} {word()} ann@example.org {' '.join(word() for _ in range(60))}"
    rows += [(201 + k, f"{passage} {word()}") for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.spans for x in pii.op8(docs).collect()}
    for d, t in rows:
        extra = [(m.start(), 5, m.end()) for m in re.finditer("Quillfeather", t)]
        assert got[d] == pii.joined(sorted(brute(t) + extra))
    made = {x.doc_id: x.text for x in pii.sanitise(docs).collect()}
    assert not any("Quillfeather" in t for t in made.values())
    assert all(made[d] == t for d, t in rows if "@" not in t and "Quillfeather" not in t)


def brute_told(rows):
    """(term, entity): documents with both, with the term, with the entity; of pairs with three unlike contexts."""
    docs = sorted({(d is None, d or 0, t or "") for d, t in rows})
    found = {}
    for at, (*_, t) in enumerate(docs):
        spans = brute(t)
        inside = [any(a <= i < b for a, _, b in spans) for i in range(len(t))]
        terms = [(m[0].lower(), m.start()) for m in re.finditer(r"[^\W\d_]{3,}", t) if not any(inside[m.start() : m.end()])]
        seen = set()
        for a, k, b in spans:
            entity = (k, t[a:b].lower() if k < 2 else re.sub("[^0-9]", "", t[a:b]))
            near = tuple(w for w, s in terms if s < a)[-6:] + tuple(w for w, s in terms if s >= b)[:6]
            for w in {w for w, _ in terms} if entity not in seen else {w for w, _ in terms} & set(near):
                found.setdefault((w, entity), []).append((near or t, at))
            seen.add(entity)
    words = [{m[0].lower() for m in re.finditer(r"[^\W\d_]{3,}", t) if not any(a < m.end() and m.start() < b for a, _, b in brute(t))} for *_, t in docs]
    has = [{(k, t[a:b].lower() if k < 2 else re.sub("[^0-9]", "", t[a:b])) for a, k, b in brute(t)} for *_, t in docs]
    return sorted((w, len({i for _, i in x}), sum(w in s for s in words), sum(e in s for s in has), len(docs)) for (w, e), x in found.items() if len({c for c, _ in x}) >= 3)


@pytest.mark.parametrize("seed,first", [(0, 20_000), (1, 20_000), (2, 10), (3, 1)])
def test_counts_against_brute_force(spark, monkeypatch, seed, first):
    monkeypatch.setattr(pii, "FIRST_DOCS", first)
    monkeypatch.setattr(pii, "SHARE", 0.25)
    monkeypatch.setattr(pii, "BITS", 0.1)
    r = random.Random(seed)
    vocabulary = [r.choice("xyz") * r.choice([3, 5, 300]) + r.choice("abcdefgh") for _ in range(25)]
    rows = []
    for k in range(80):
        words = r.choices(vocabulary, k=r.choice([0, 3, 30, 60]))
        for _ in range(r.randrange(3)):
            words.insert(r.randrange(len(words) + 1), r.choice(["ann@example.org", "Ann@example.org", "10.0.0.1", "bob@example.org"]))
        rows.append((k, " ".join(words)))
    rows += [(1, rows[2][1]), (None, rows[3][1]), (None, rows[3][1]), (90, None), (91, ""), *[rows[k] for k in (4, 5, 5, 6, 6, 6)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(x.term, x.together, x.total, x.of_entity, x.n) for x in pii.told(docs, pii.find(docs)).collect()]
    over = lambda x: x[1] / x[2] >= pii.SHARE and x[1] / x[2] * x[4] / x[3] >= 2**pii.BITS
    every = brute_told(rows)
    assert set(got) <= set(every) and len(got) < len(every)
    assert sorted(filter(over, got)) == sorted(filter(over, every)) and len(list(filter(over, got))) > 5


def test_repeated_rows_count_once(spark):
    """A term that reveals, each row three times: the same spans as without the repeats."""
    rows = [(k, f"{'ab'[k % 2] * (3 + k)} Quillfeather {'w' * 300}{'abcdefghij'[k]} ann@example.org {'cd'[k % 2] * (4 + k)}") for k in range(10)] + [(20 + k, f"plain text {k * 'z'}") for k in range(200)]
    one, three = (spark.createDataFrame(x, "doc_id long, text string") for x in (rows, 3 * rows))
    spans = lambda d: {(x.doc_id, x.spans) for x in pii.op8(d).collect()}
    assert spans(one) == spans(three) and sum("removed" in s for _, s in spans(one)) == 10
