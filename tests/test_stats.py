"""Exact ranks of groups that no task may sort, against sorting."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import stats


def values(seed):
    r = random.Random(seed)
    rows = [(g, r.choice([0.0, 0.0, 0.0, r.gauss(0, 1), r.gauss(1e9, 1), -1e300, float(r.randrange(5))])) for g in (1, 1, 1, 2, None) for _ in range(400)]
    return rows + [(3, 5.0)] * 300 + [(4, None)] * 3 + [(5, 1.5)]


@pytest.mark.parametrize("seed", range(2))
def test_at_ranks(spark, seed):
    rows = values(seed)
    ranks = {"low": F.lit(1), "third": F.floor(F.col("n") / 3) + 1, "high": F.col("n"), "none": F.col("n") + 1}
    got = {x.g: x for x in stats.at_ranks(spark.createDataFrame(rows, "g long, v double"), ["g"], ["v"], ranks).collect()}
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert set(got) == set(groups)
    for g, vs in groups.items():
        vs.sort()
        assert (got[g].n_v, got[g].v_low, got[g].v_third, got[g].v_high, got[g].v_none) == (len(vs), vs[0], vs[len(vs) // 3], vs[-1], None)


def test_no_window_by_group_alone(spark):
    d = spark.createDataFrame([(1, 2.0)], "g long, v double")
    plan = stats.at_ranks(d, ["g"], ["v"], {"m": F.floor(F.col("n") / 2) + 1})._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("__cell" in w for w in windows)  # totals in order of the cells, or rows within one


def test_large_groups_as_small_ones(spark):
    r = random.Random(5)
    rows = [(c, r.choice([r.uniform(0, 3840), 1900.0 + r.gauss(0, 20)]), 1000.0 + r.gauss(0, 40), r.choice([100.0, 300.0 + r.gauss(0, 30)])) for c, n in ((1, 500), (2, 30), (3, 7), (4, 900), (5, 1)) for _ in range(n)]
    d = spark.createDataFrame(rows, "clip_id long, cx double, cy double, h double")
    near = lambda df: sorted(tuple(round(v, 6) for v in x) for x in df.collect())
    assert near(stats.robust_center(d, 3840, 2160, most=100)) == near(stats.robust_center(d, 3840, 2160))
    p = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    assert near(stats.percentiles(d, "clip_id", "cx", p, most=100)) == near(stats.percentiles(d, "clip_id", "cx", p))
