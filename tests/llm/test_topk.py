import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=5):
    """All products, in whole numbers of any size."""
    fine = []
    for i, x in rows:
        if x is not None and all(v is not None and math.isfinite(v) for v in x):
            fine.append((i, [math.floor(256 * float(np.float32(v))) for v in x]))
    out = []
    for q, x in fine:
        if q is not None and q % 50 == 0:
            scores = [(-max(-topk.LONG, min(topk.LONG, sum(a * b for a, b in zip(x, y)))), i is None, i or 0) for i, y in fine if i != q]
            out += [(q, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def vectors(r, n, dims):
    made = [(k, [r.gauss(0, 0.2) for _ in range(dims)]) for k in range(n)]
    some = made[7][1]
    return made + [(1000 + k, some) for k in range(12)] + [(2000, some), (2050, [0.0] * dims)]


@pytest.mark.parametrize("dims", [1, 3, 16, 17, 64])
def test_op13(spark, dims):
    """Ties by equal vectors, nulls, lengths that differ, ids given twice or not at all."""
    rows = vectors(random.Random(dims), 160, dims)
    rows += [(50, rows[3][1]), (4000, None), (4001, [None] * dims), (4050, [float("nan")] + [1.0] * (dims - 1)), (4002, [float("inf")] * dims), (None, rows[0][1]), (None, rows[0][1]), (4100, []), (4003, [5.0] * (dims + 2))]
    got = sorted(map(tuple, topk.op13(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == brute(rows)


def test_blocks(spark, monkeypatch):
    """Many cells give what one gives, and one very common vector is spread over them."""
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 40)
    rows = vectors(random.Random(9), 400, 8)
    rows += [(None, rows[5][1])] * 50 + [(50 * k, rows[5][1]) for k in range(100, 120)]
    got = sorted(map(tuple, topk.op13(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == brute(rows)


def test_scores_beyond_doubles(spark):
    rows = [(0, [1e9, 1.0]), (1, [1e9, 2.0]), (2, [1e9, 3.0]), (3, [-3e38, 1.0]), (4, [3e38, 0.0]), (50, [3e38, 1.0]), (5, [1e9, -7.0])]
    got = sorted(map(tuple, topk.op13(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == brute(rows)


def test_bounds_hold_and_sharpen():
    r = np.random.default_rng(1)
    for dims in (1, 2, 5, 16, 63, 64):
        q, x = np.floor(r.normal(0, 50, (40, dims))), np.floor(r.normal(10, 50, (60, dims)))
        exact = q @ x.T
        coarse, fine = (topk.summaries(q, s) @ topk.summaries(x, s).T for s in topk.SEGMENTS)
        assert (coarse >= exact - 1e-6).all() and (fine >= exact - 1e-6).all() and (fine <= coarse + 1e-6).all()
        assert np.allclose((topk.summaries(q, 4) ** 2).sum(1), (q * q).sum(1))


def test_few_pairs_are_scored():
    """Smooth vectors of many kinds: most candidates are never scored, and none of the best is missed."""
    r = np.random.default_rng(2)
    kinds = np.repeat(r.normal(0, 60, (40, 16)), 4, axis=1)
    x = np.floor(kinds[r.integers(0, 40, 4000)] + r.normal(0, 6, (4000, 64)))
    best = topk.Best(x[:100], np.arange(100), 5)
    best.meet(x, np.arange(4000), np.zeros(4000, bool))
    assert best.scored < 0.2 * 100 * 4000
    exact = x[:100] @ x.T
    exact[np.arange(100), np.arange(100)] = -np.inf
    want = -np.sort(-exact, axis=1)[:, :5]
    got = best.found[np.lexsort((-best.found[:, 1], best.found[:, 0]))][:, 1].reshape(100, 5)
    assert (got == want).all()


def test_empty_and_clashing_names(spark):
    assert topk.op13(spark.createDataFrame([], SCHEMA)).collect() == []
    assert topk.op13(spark.createDataFrame([(1, [1.0])], SCHEMA)).collect() == []
    rows = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(0, 120, 10)], SCHEMA)
    wide = rows.select("*", *(F.lit(1).alias(c) for c in "x vector asks n kind cell row other score rank query_id".split()))
    assert sorted(map(tuple, topk.op13(wide).collect())) == sorted(map(tuple, topk.op13(rows).collect()))
