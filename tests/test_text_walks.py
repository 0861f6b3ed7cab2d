"""Phrases of any length, letters spelt in ASCII, strings of JSON of any shape."""

import json
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import entities, words


def said(spark, texts):
    rows = [(s, k, w, 100 * k, 100 * k + 60) for s, line in enumerate(texts) for k, w in enumerate(line.split())]
    return spark.createDataFrame(rows, "source_id long, pos long, text string, start_ms long, end_ms long")


def plain_hits(texts, phrases):
    out = {}
    for s, line in enumerate(texts):
        own = [w.lower().strip(".,!?") for w in line.split()]
        for i, p in set(phrases):
            want = p.split(" ")
            at = [100 * k for k in range(len(own) - len(want) + 1) if own[k : k + len(want)] == want]
            if at:
                n, first = out.get((s, i), (0, 1 << 60))
                out[s, i] = n + len(at), min(first, at[0])
    return out


@pytest.mark.parametrize("seed", range(2))
def test_phrases_of_any_length(spark, seed, monkeypatch):
    r = random.Random(seed)
    monkeypatch.setattr(words, "FIRSTS_BYTES", -1 if seed else 8 << 20)  # joined, or sent
    texts = [" ".join(r.choices(["a", "B", "c,", "a", "d!", "e"], k=r.randrange(60))) for _ in range(12)]
    phrases = [(r.randrange(25), " ".join(r.choices("abcde", k=r.choice([1, 2, 3, 6, 9])))) for _ in range(60)] + [(77, "")]
    got = {(x.source_id, x.phrase_id): (x.n, x.first_ms) for x in words.phrase_hits(said(spark, texts), spark.createDataFrame(phrases * 2, "phrase_id long, phrase string")).collect()}
    assert got == plain_hits(texts, [p for p in phrases if p[1]]) and len(got) > 40


def test_a_large_lexicon(spark):
    """100,000 phrases as a table; the plan has no expression a phrase and no join without equal keys."""
    phrases = spark.range(100_000).select(F.col("id").alias("phrase_id"), F.concat(F.lit("w"), F.col("id"), F.lit(" x y"), F.when(F.col("id") % 2 == 0, " z").otherwise("")).alias("phrase"))
    texts = ["w7 x y w8 x y z w9 x", "W100000 x y. w99999, x y"]
    hits = words.phrase_hits(said(spark, texts), phrases)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and len(plan) < 60_000
    assert sorted((x.source_id, x.phrase_id, x.n) for x in hits.collect()) == [(0, 7, 1), (0, 8, 1), (1, 99_999, 1)]


def test_both_must_hit(spark):
    lexicon = spark.createDataFrame([(0, "logo", "in the", "In", 1), (1, "person", "dan", "Dan", 1), (2, "logo", "dan", "Dan", 1), (3, "logo", "on", "On", 1)], "k int, type string, key string, name string, len int")
    said_first = spark.createDataFrame([(s, key, 0) for s in (1, 2) for key in ("in the", "dan")], "source_id long, key string, t long")
    texts = spark.createDataFrame([(1, "in, the danube on"), (2, "(in the) dan")], "source_id long, text string")
    got = sorted((x.source_id, x.k) for x in entities.mentioned(said_first, texts, lexicon).collect())
    assert got == [(1, 1), (2, 0), (2, 1), (2, 2)]


def test_every_latin_letter():
    """As by compatibility decomposition without marks, on every Latin small letter that has one; by its name on those with a stroke or a hook."""
    table = T.transliteration()
    n = 0
    for code in range(0xAA, 0x1F00):
        c = chr(code)
        if not unicodedata.name(c, "").startswith("LATIN SMALL") or c.lower() != c:
            continue
        flat = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        if flat.isascii():
            assert table[c] == flat, c
            n += 1
        elif m := re.fullmatch(r"LATIN SMALL LETTER ([A-Z]) WITH .*", unicodedata.name(c)):
            assert table[c] == m[1].lower(), c
    assert n > 250


def test_slugs(spark):
    rows = {"Łódź & Çedilla": "lodz-cedilla", "Œuvre STRASSE straße": "oeuvre-strasse-strasse", "Café ﬁn": "cafe-fin", "Привет, Щука": "privet-shchuka", "Ωμέγα ψ": "omega-ps", "漢字": "", "Ĳssel đð þorn": "ijssel-dd-thorn", "подъезд ь": "podezd", "Ёж": "iozh"}
    d = spark.createDataFrame([(k,) for k in rows], "x string")
    assert {x.x: x.s for x in d.select("x", T.slug(F.col("x")).alias("s")).collect()} == rows


def walked(x, change):
    if isinstance(x, str):
        return change(x)
    if isinstance(x, list):
        return [walked(v, change) for v in x]
    return {k: walked(v, change) for k, v in x.items()} if isinstance(x, dict) else x


def made(r, depth=0):
    kind = r.randrange(8 if depth < 4 else 5)
    if kind < 3:
        return "".join(r.choices(["a", "—", '"', "\\", "\n", "é", ":", "{", "[", ",", "😀", "\t"], k=r.randrange(6)))
    if kind < 5:
        return r.choice([None, True, False, 0, -1.5, 12345678901234567890, 1e300])
    if kind == 5:
        return {f"k—{k}" if k % 2 else f'"{k}\\': made(r, depth + 1) for k in range(r.randrange(4))}
    return [made(r, depth + 1) for _ in range(r.randrange(4))]


def test_every_json_string(spark):
    r = random.Random(3)
    records = [made(r) for _ in range(400)]
    texts = [json.dumps(x, ensure_ascii=k % 2 == 0, indent=2 if k % 3 == 0 else None) for k, x in enumerate(records)]
    rows = list(enumerate(texts)) + [(-1, None), (-2, "{not json"), (-3, json.dumps({"a": "x" * 300_000 + "—"}))]
    change = lambda c: F.replace(c, F.lit("—"), F.lit("-"))
    got = {x.k: x.y for x in spark.createDataFrame(rows, "k long, x string").select("k", T.every_json_string(F.col("x"), change).alias("y")).collect()}
    assert got[-1] is None and got[-2] is None and got[-3].changed and json.loads(got[-3].value) == {"a": "x" * 300_000 + "-"}
    for k, x in enumerate(records):
        want = walked(x, lambda s: s.replace("—", "-"))
        assert json.loads(got[k].value) == want and got[k].changed == (want != x), texts[k]
        assert got[k].changed or got[k].value == texts[k]
