"""Places in one order over a whole table."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import publishing, ranks


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_numbered(spark, buckets):
    r = random.Random(buckets)
    rows = [(r.choice([None, 0, 0, 0, 1, 7]), r.choice([None, "a", "b", "é", ""]), r.randrange(-(2**63), 2**63)) for _ in range(3000)]
    low = lambda x: (x is not None, 0 if x is None else x)
    text = lambda x: (x is not None, (x or "").encode())
    want = sorted(rows, key=lambda x: (low(x[0]), text(x[1]), x[2]))
    made = ranks.numbered(spark.createDataFrame(rows, "s int, t string, id long").repartition(5), ["s", "t", "id"], "k", buckets)
    got = sorted(made.collect(), key=lambda x: x.k)
    assert [x.k for x in got] == list(range(3000)) and [tuple(x)[:3] for x in got] == want


def test_repeated_rows_and_empty(spark):
    d = spark.createDataFrame([(1,)] * 7 + [(0,)] * 5, "a long")
    got = sorted((x.k, x.a) for x in ranks.numbered(d, ["a"], "k").collect())
    assert got == [(k, 0 if k < 5 else 1) for k in range(12)]
    assert ranks.numbered(d.limit(0), ["a"], "k").collect() == []


def test_balanced_without_a_single_task(spark):
    """Random 64-bit ids, three of four with one score: no bucket has much more than its share, and no window is without a partition."""
    d = spark.range(20_000).select(F.when(F.col("id") % 4 > 0, 5).otherwise(F.col("id") % 97).alias("score"), F.xxhash64("id").alias("id"))
    made = ranks.numbered(d, ["score", "id"], "k", 16)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    window = plan[plan.index("Window") :].splitlines()[0]
    assert "__bucket" in window
    from unittest import mock

    with mock.patch.object(type(made), "drop", lambda self, *c: self):
        kept = ranks.numbered(d, ["score", "id"], "k", 16)
    sizes = [x["count"] for x in kept.groupBy("__bucket").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 20_000 / 16


def test_calendar(spark):
    items = spark.createDataFrame([(k * 7919 % 101, k) for k in range(100)], "down int, base long")
    got = {x.base: x.publish_at for x in publishing.scheduled(items, ["down", "base"], "2026-02-27", ("09:00", "13:30", "18:00"), 2).collect()}
    for place, (_, base) in enumerate(sorted((k * 7919 % 101, k) for k in range(100))):
        import datetime

        day = datetime.date(2026, 2, 27) + datetime.timedelta(days=place // 2)
        assert got[base] == f"{day}T{('09:00', '13:30')[place % 2]}:00"
