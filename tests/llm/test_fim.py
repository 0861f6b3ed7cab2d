import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import fim

UNITS = {"lines": r"[^\n]*\n|[^\n]+", "words": r"[^ \t\n\v\f\r]*[ \t\n\v\f\r]+|[^ \t\n\v\f\r]+", "chars": r"(?s)."}


@pytest.mark.parametrize("kind", list(UNITS))
def test_every_cut_against_units(kind):
    r = random.Random(1)
    for k in range(300):
        text = "".join(r.choices("ab\n\n  é漢😀\t", k=r.randrange(12))) if k else "\n\n\n"
        raw = np.frombuffer(text.encode(), np.uint8)
        units, runs = re.findall(UNITS[kind], text), fim.encode(raw, kind)
        assert runs.n == len(units)
        for u in range(len(units) + 1):
            head = "".join(units[:u])
            assert fim.cut(runs, len(raw), u) == (len(head.encode()), len(head)), (text, u)


def test_runs_are_few():
    """What is stored is one row a run, not one a unit."""
    raw = np.frombuffer(b"\n" * 100_000 + b"x" * 100_000 + b"\n" * 5, np.uint8)
    runs = fim.encode(raw)
    assert runs.n == 100_005 and len(runs.begins) == 3
    assert len(fim.encode(np.frombuffer("é".encode() * 5000, np.uint8), "chars").begins) == 1


def plain(doc_id, text):
    text = text or ""
    units = re.findall(UNITS["lines"], text)
    n, h = len(units), hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return doc_id, n, "plain", None, None, digest(text), digest(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 50 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, form, len(p), len(m), digest(out), digest(text)


def test_op12(spark):
    r = random.Random(2)
    atoms = ["\n", "\n\n", "a", "é", "漢", "<", "P>", "<P", "<M", ">", "S", " ", "\r", " ", "\x00"]
    rows = [(k, "".join(r.choices(atoms, k=r.randrange(30)))) for k in range(300)]
    rows += [(None, None), (None, "x\ny"), (5, ""), (6, "a<S>b"), (7, "\n"), (8, "z" * 400_000), (9, "\n" * 300_000 + "é"), rows[3], rows[3], (-4, "n\nm\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, fim.op12(docs).collect()), key=str)
    assert got == sorted((plain(*x) for x in rows), key=str)
    assert {x[2] for x in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("kind", ["words", "chars"])
def test_outputs_of_other_units(spark, kind):
    docs = spark.createDataFrame([(k, "Ein Wörtchen, dann\nnoch eins " * (k % 3), "x") for k in range(60)], "doc_id long, text string, output string")
    made, name = fim.transform(docs, kind=kind, share=80, spm=30)
    rows = made.withColumn("back", fim.restore(F.col(name)["output"], F.col(name)["form"])).collect()
    assert all(x.back == x.text for x in rows) and {x[name].form for x in rows} == {"plain", "psm", "spm"}
    for x in rows:
        if (m := x[name]).form == "psm":
            assert m.output == f"<P>{x.text[: m.prefix_chars]}<S>{x.text[m.prefix_chars + m.middle_chars :]}<M>{x.text[m.prefix_chars : m.prefix_chars + m.middle_chars]}"


def test_empty_and_clashing_names(spark):
    assert fim.op12(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    docs = spark.createDataFrame([(1, "a\nb", 5), (None, None, None)], "doc_id long, text string, fim long")
    made, name = fim.transform(docs)
    assert name == "_fim" and made.columns == ["doc_id", "text", "fim", "_fim"] and made.count() == 2
