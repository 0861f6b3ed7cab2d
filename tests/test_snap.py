"""Words and targets along one stream: results by brute force, and what is shuffled."""

import random

import pytest

from spanloom.functions import params as P
from spanloom.operators import words
from tests.test_timelines import dealt_texts


def best(mine, t, after):
    """The gap that suits a target best, over all gaps: (mid2, tier)."""
    if len(mine) < 2:
        return 2 * t, None
    found = []
    for (pos, text, _, end), (_, _, start, _) in zip(mine, mine[1:]):
        if start > end:
            mid2, size = end + start, start - end
            d, wide = abs(mid2 - 2 * t), after and mid2 >= 2 * t
            near = lambda a, b: d <= 2 * P.SNAP_WINDOW * (a if wide else b)  # noqa: B023, E731
            tier = 0 if text[-1] == "." and size >= P.SNAP_SILENCE and near(3, 1) else 1 if size >= P.SNAP_BREATH and near(3, 1) else 2 if near(5, 2.5) else 3 if near(8, 5) else 4
            found.append((tier, d if tier == 4 else d * (7 if wide else 13 if after else 10), pos, mid2))
    return (min(found)[3], min(found)[0] if min(found)[0] < 4 else None) if found else (None, None)


@pytest.mark.parametrize("step", [1, 50])
def test_snap_by_brute_force(spark, step):
    """Also words that overlap or go back in time, gaps with one middle, several targets at one time. Coarse steps make ties."""
    r = random.Random(step)
    said, asked = [], []
    for k in range(60):
        at = 0
        for pos in range(r.choice([0, 1, 2, 3, 8, 40])):
            start = at + r.randrange(-600 if k % 3 == 0 else 0, 700) // step * step
            at = start + r.randrange(50, 900) // step * step
            said.append((k, pos, r.choice(["a", "b.", "c"]), start, at))
        asked += [(k, j, r.randrange(-3000, at + 9000) // step * step if j != 3 else 400, r.random() < 0.5) for j in range(12)]
    w = spark.createDataFrame(said, "source_id long, pos long, text string, start_ms long, end_ms long").repartition(3)
    got = {(x.source_id, x.target): (x.mid2, x.tier) for x in words.snap(spark.createDataFrame(asked, "source_id long, target int, t_ms long, after boolean"), w).collect()}
    assert len(got) == len(asked)
    for k, j, t, after in asked:
        assert got[k, j] == best([x[1:] for x in said if x[0] == k], t, after), (k, j)


@pytest.mark.parametrize("name", ["boundary_snap", "snapped_clips"])
def test_only_texts_are_shuffled(spark, monkeypatch, name):
    dealt_texts(spark, monkeypatch, name)
