import random
import re
from collections import Counter
from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from spanloom.llm import quality


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if at[tuple(w[i : i + 3])] > 1 for k in range(3)}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def fixture():
    r = random.Random(6)
    rows = []
    for k in range(200):
        words = r.choices(["a", "Été", "b#", "c|", "Ü", "dd", "\x85", "e\xa0f", "🙂"] + [f"w{i}" for i in range(r.choice([3, 50, 4000]))], k=r.choice([0, 1, 2, 3, 4, 20, 60, 500]))
        rows.append((k, "".join(w + r.choice([" ", "  ", "\n", "\t", "\n\n", "\r\n", "\x0b"]) for w in words)))
    return rows + [(None, None), (200, ""), (201, " \n "), (5, rows[5][1]), (202, "x y x y x y x"), (203, "a a a a")]


def test_features(spark):
    rows = fixture()
    docs = spark.createDataFrame([(*x, "en", 1) for x in rows], "doc_id long, text string, lang string, n_words int")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = sorted((x.doc_id is None, x.doc_id or 0, *x[1:7]) for x in quality.op2(docs, labels).collect())
    assert got == sorted((d is None, d or 0, *brute(t)) for d, t in rows)


@pytest.mark.parametrize("n,k,p", [(10, 0, 0.5), (300, 0, 0.01), (5000, 20, 0.01), (5000, 49, 0.01), (2000, 1, 0.25), (40, 39, 0.99)])
def test_binomial_tail(spark, n, k, p):
    q = Fraction(p)
    want = float(sum(comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k + 1)))
    got = spark.range(1).select(quality.binomial_tail(F.lit(n), F.lit(k), p)).first()[0]
    assert got == pytest.approx(want, rel=1e-7)


def test_cutoffs_and_verdicts(spark):
    r = random.Random(2)
    rows, labels = [], []
    for k in range(3000):
        bad = k % 10 == 0
        words = [f"w{r.randrange(10**6)}" + ("###" if bad else "") for _ in range(60)]
        rows.append((k, " ".join(words), "en" if k % 3 else None, 7))
        if k % 2 == 0:
            labels.append((k, 0 if bad else 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int")
    marks = spark.createDataFrame([*labels, (4, 1), (None, 0), (2, None)], "doc_id long, quality int")
    got = {x.doc_id: x.kept for x in quality.op2(docs, marks).collect()}
    en = {k for k in got if k % 3}
    assert all(got[k] == (k % 10 != 0) for k in en)
    kept = quality.keep_good(docs, marks)
    assert kept.columns == docs.columns
    assert {x.doc_id for x in kept.collect()} == {k for k in got if got[k]}


def brute_cutoffs(rows, labels):
    """rows: (doc_id, text, lang). Of each stratum and rule with a certified cutoff, the cutoff; by exact binomial sums."""
    marks = {}
    for d, q in labels:
        if d is not None and q is not None:
            marks[d] = min(q, marks.get(d, q))
    values = {}
    for d, t, lang in rows:
        n, chars, symbols, dups, repeats, failed = brute(t)
        if failed or d not in marks:
            continue
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        capitals = len(re.findall("[A-ZÀ-ÖØ-Þ]", t))
        for rule, over, under in (("symbols", symbols, chars), ("dup_lines", dups, len(lines)), ("repeats", repeats, n), ("capitals", capitals, chars)):
            values.setdefault((lang, rule), []).append((1000 * over // under if under else 0, marks[d] >= 1))
    out = {}
    for key, found in values.items():
        a, b, step = quality.RULES[key[1]][1]
        n, best, p = sum(good for _, good in found), None, Fraction(quality.RISK) / len(quality.RULES)
        for cutoff in range(a, b - 1, -step):
            good, bad = (sum(v > cutoff and g == want for v, g in found) for want in (True, False))
            if sum(comb(n, i) * float(p) ** i * (1 - float(p)) ** (n - i) for i in range(good + 1)) > quality.ERROR / len(values):
                break
            if best is None or bad - quality.COST * good > best[0]:
                best = (bad - quality.COST * good, cutoff)
        if best:
            out[key] = best[1]
    return out


def planted(n, seed=4):
    """Texts of two languages and of none, whose symbols, capitals, repeats and lines grow with a grade; labels after it, with some noise."""
    r = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        lang, grade = r.choice(["en", "en", "de", None]), r.random() ** 4
        words = [f"w{r.randrange(10**6)}" for _ in range(60)]
        words = [w.upper() if r.random() < grade and k % 4 == 0 else w + "###" if r.random() < grade and k % 4 == 1 else words[i - 5] if i > 5 and r.random() < grade / 2 and k % 4 == 2 else w for i, w in enumerate(words)]
        lines = [" ".join(words[i : i + 6]) for i in range(0, 60, 6)]
        if k % 4 == 3:
            lines = [r.choice(lines[:2]) if r.random() < grade / 2 else x for x in lines]
        rows.append((k, "\n".join(lines), lang))
        if k % 10:
            labels.append((k, int((grade < 0.3) ^ (r.random() < 0.004))))
    return rows, labels


def test_certified_cutoffs_against_brute_force(spark):
    rows, labels = planted(4000)
    labels += [(1, 0), (1, 1), (None, 0), (2, None)]
    want = brute_cutoffs(rows, labels)
    assert len(want) > 5 and len({lang for lang, _ in want}) == 3
    docs = spark.createDataFrame([(*x, "z") for x in rows], "doc_id long, text string, lang string, stratum string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    marked = quality.stash(quality.features(docs.select("doc_id", "text", quality._stratum(F.col("lang")).alias("stratum")), "doc_id", "stratum"))
    got = {}
    for x in quality.cutoffs(marked, marks).collect():
        got |= {(x.stratum[1:] if x.stratum else None, r): x[f"cut_{r}"] for r in quality.RULES if x[f"cut_{r}"] is not None}
    assert got == want
    kept = {x.doc_id: x.kept for x in quality.op2(docs, marks).collect()}
    for d, t, lang in rows:
        n, chars, symbols, dups, repeats, failed = brute(t)
        lines, capitals = len(t.split("\n")), len(re.findall("[A-ZÀ-ÖØ-Þ]", t))
        beyond = {"symbols": 1000 * symbols // chars, "dup_lines": 1000 * dups // lines, "repeats": 1000 * repeats // n, "capitals": 1000 * capitals // chars}
        assert kept[d] == (not failed and not any(v > want.get((lang, rule), 10**9) for rule, v in beyond.items()))
    assert not all(kept[d] for d, t, _ in rows if not brute(t)[-1])


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.op2(docs, labels).collect() == [] and quality.keep_good(docs, labels).collect() == []
