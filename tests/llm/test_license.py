import random
import re
import textwrap
from fractions import Fraction

import pytest

from spanloom.llm import license

WORD = re.compile("[a-z0-9À-῿⁀-\U0010ffff]+")
FLAT = license._flat(license.TEMPLATES)
COLUMNS = "doc_id long, text string, best_license string"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def bigrams(w):
    return set(zip(w, w[1:]))


def brute(text, flat=FLAT):
    """All windows, lines and whole texts against all templates, without bounds."""
    w, found, at = words(text), [], 0
    units = [(0, len(w))]
    for line in (text or "").split("\n"):
        n = len(words(line))
        units.append((at, at + n))
        at += n
    for k, (_, t) in enumerate(flat):
        size, s = len(words(t)), bigrams(words(t))
        for a, b in [*units, *((a, a + size) for a in range(len(w) - size + 1))]:
            own = bigrams(w[a:b])
            if own and Fraction(2 * len(own & s), len(own) + len(s)) >= Fraction(8, 10):
                found.append((-len(own & s), len(own) + len(s), k, a, b))
    taken = []
    for x in sorted(found):
        if all(x[3] >= y[4] or x[4] <= y[3] for y in taken):
            taken.append(x)
    best = taken[0] if taken else None
    return len(taken), ",".join(sorted({flat[x[2]][0] for x in taken})), best and flat[best[2]][0], best and -2 * best[0] / best[1]


def scanned(spark, rows):
    return license.op1(spark.createDataFrame([(*x, "y") for x in rows], COLUMNS))


def test_against_all_pairs(spark):
    r = random.Random(2)
    rows = [(None, None), (1, ""), (2, "\n\n"), (3, "Release" + "d under the MIT License."), (4, "x"), (5, "é —")]
    for k in range(150):
        lines = []
        for _ in range(r.randrange(4)):
            w = r.choice(FLAT[:12])[1].split()
            for _ in range(r.randrange(3)):
                w[r.randrange(len(w))] = r.choice(["é", "the", "X"])
            lines.append(r.choice(["", "// ", "* "]) + " ".join(w) + r.choice(["", "\r", " foo", "!"]))
        rows.append((10 + k, r.choice(["\n", " "]).join([*lines, *r.choices(["", "some words of prose here"], k=r.randrange(2))])))
    rows.append(rows[-1])
    got = scanned(spark, rows).collect()
    assert sorted(tuple(map(str, x)) for x in got) == sorted((str(d), *map(str, brute(t))) for d, t in rows)
    assert sum(x.n_matches > 0 for x in got) > 50


def prose(r, n):
    return "\n".join(" ".join(r.choices("this software code is made by the people who may use any of it for work and fun".split(), k=12)) for _ in range(n))


@pytest.mark.parametrize("name", list(license.TEMPLATES))
def test_wrapped_notices_within_long_files(spark, name):
    """Each template at 72 signs a line, behind comment marks, with curly quotes and a copyright line, in the midst of 40 lines each side."""
    r, rows = random.Random(name), []
    for k, t in enumerate([license.TEMPLATES[name]] if isinstance(license.TEMPLATES[name], str) else license.TEMPLATES[name]):
        t = re.sub('"([^"]*)"', "“\\1”", " ".join(t.split()))
        for j, mark in enumerate(["", "# ", " * "]):
            notice = "\n".join(mark + x for x in textwrap.wrap(t, 72))
            rows.append((10 * k + j, f"{prose(r, 40)}\n{mark}Copyright © 2020–2024 A. N. Author\n{mark}\n{notice}\n{prose(r, 40)}"))
        rows.append((10 * k + 5, f"{prose(r, 3)} {t} {prose(r, 3)}".replace("\n", " ")))
    got = {x.doc_id: tuple(x)[1:] for x in scanned(spark, rows).collect()}
    for d, t in rows:
        assert got[d] == brute(t) and got[d][2] == name and got[d][3] > 0.95, d


def test_found_in_prose(spark):
    rows = [(1, "Released under the “MIT License”."), (2, "The tool is licensed under the Apache License, Version 2.0. Released under the MIT License. Enjoy!")]
    got = {x.doc_id: (x.n_matches, x.licenses) for x in scanned(spark, rows).collect()}
    assert got == {1: (1, "MIT"), 2: (2, "Apache-2.0,MIT")}
    assert scanned(spark, [(k, prose(random.Random(k), 50)) for k in range(20)]).where("n_matches > 0").count() == 0


def test_long_text_of_many_copies(spark):
    import time

    mit = license.TEMPLATES["MIT"][2]
    began = time.perf_counter()
    (x,) = scanned(spark, [(1, "\n".join([" ".join(mit.split())] * 600))]).collect()
    assert x.n_matches == 600 and x.licenses == "MIT" and time.perf_counter() - began < 60


def test_empty(spark):
    assert scanned(spark, []).collect() == []
    docs = spark.createDataFrame([(1, "MIT")], "doc_id long, text string")
    assert [x.n_matches for x in license.op1(docs, {}).collect()] == [0]
    assert [x.n_matches for x in license.op1(docs, {"one": "MIT", "none": ""}).collect()] == [0]
