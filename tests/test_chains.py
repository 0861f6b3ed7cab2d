"""Chains of pointers against folds along sorted rows."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import chains, intervals


@pytest.mark.parametrize("seed", range(2))
def test_greedy(spark, seed):
    """Spans without length, backwards, repeated whole; null keys."""
    r = random.Random(seed)
    rows = [(r.choice([1, 1, 2, 3]), t, t + r.choice([0, 0, -3, 5, 20, 90]), r.randrange(6)) for t in (r.randrange(700) for _ in range(260))]
    d = spark.createDataFrame(rows + rows[:20], "k long, start_ms long, end_ms long, id long")
    want = sorted(map(tuple, intervals.greedy(d, "k", "id").collect()))
    assert sorted(map(tuple, chains.greedy(d, "k", "id", 50).collect())) == want and 30 < len(want) < 280
    if not seed:
        assert sorted(map(tuple, intervals.greedy(d, "k", "id", most=100, cell_ms=50).collect())) == want


def test_apart(spark):
    r = random.Random(3)
    rows = [(r.choice([1, 1, 2]), r.randrange(900), r.choice("aaab"), r.randrange(3)) for _ in range(300)]
    d = spark.createDataFrame(rows + rows[:10], "k long, t_ms long, slot string, n long")
    want = sorted(map(tuple, intervals.apart(d, "k", 40).collect()))
    assert sorted(map(tuple, chains.apart(d, "k", 40, 100).collect())) == want and 40 < len(want) < 310


def test_no_python_and_no_window_by_key_alone(spark):
    d = spark.range(50).select(F.lit(1).alias("k"), (F.col("id") * 30).alias("start_ms"), (F.col("id") * 30 + 45).alias("end_ms"), "id")
    kept = chains.greedy(d, "k", "id", 200)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Window" not in plan and kept.count() == 25
