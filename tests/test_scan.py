"""Running values by slices, against one window a key; one key with very many rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom.operators import intervals, scan, words


@pytest.mark.parametrize("inclusive", [True, False])
def test_running(spark, inclusive):
    r = random.Random(1)
    rows = [(r.choice([1, 1, 1, 2, None]), t, k, r.choice([None, r.randrange(-50, 50)])) for k, t in enumerate(sorted(r.randrange(-500, 3000) for _ in range(2000)))]
    d = spark.createDataFrame(rows, "k long, t long, id long, v long")
    made = scan.running(d, ["k"], F.floor(F.col("t") / 100), ["t", "id"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("min", F.col("v") * 2)}, inclusive)
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    want = d.select("*", F.sum("v").over(w).alias("s"), F.max("v").over(w).alias("m"), F.min(F.col("v") * 2).over(w).alias("l"))
    assert made.columns == want.columns and sorted(map(str, made.collect())) == sorted(map(str, want.collect()))


def spans(spark, seed):
    r = random.Random(seed)
    return spark.createDataFrame([(r.choice([1, 1, 2]), t, t + r.choice([0, 5, 40, 900])) for t in (r.randrange(20_000) for _ in range(400))], "k long, start_ms long, end_ms long")


@pytest.mark.parametrize("seed", range(2))
def test_merge_and_gaps_by_slices(spark, seed):
    d, near = spans(spark, seed), lambda df: sorted(map(tuple, df.select("k", "start_ms", "end_ms").collect()))
    assert near(intervals.merge(d, "k", cell_ms=700)) == near(intervals.merge(d, "k"))
    sparse, lengths = d.where("start_ms % 9 = 0"), spark.createDataFrame([(1, 15_000), (2, 30_000), (3, 5000)], "k long, duration_ms long")
    assert near(intervals.free_gaps(sparse, lengths, "k", cell_ms=1100)) == near(intervals.free_gaps(sparse, lengths, "k"))


def test_retiming_by_slices(spark):
    r = random.Random(4)
    rows, t = [], 0
    for k in range(3000):
        a = t + r.choice([0, 20, 400, 1500])
        t = a + r.choice([10, 60, 300])
        rows.append((k // 2500, k, f"w{k}", a, t))
    w = spark.createDataFrame(rows, "source_id long, pos long, text string, start_ms long, end_ms long")
    cuts = intervals.merge(w.where("pos % 7 = 0").select("source_id", (F.col("start_ms") - 30).alias("start_ms"), (F.col("end_ms") + F.col("pos") % 90).alias("end_ms")), "source_id")
    assert sorted(map(tuple, words.retime(w, cuts, 5000).collect())) == sorted(map(tuple, words.retime(w, cuts).collect()))


def test_one_huge_key_is_many_tasks(spark):
    """A million words of one source: no partition of the result has more than a share of them."""
    n = 1_000_000
    w = spark.range(n).select(F.lit(7).cast("long").alias("source_id"), F.col("id").alias("pos"), F.lit("a").alias("text"), (F.col("id") * 100).alias("start_ms"), (F.col("id") * 100 + 60).alias("end_ms"))
    cuts = w.where("pos % 1000 = 5").select("source_id", "start_ms", "end_ms")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        kept = words.timeline_stream(w, cuts, 600_000).where("kept")
        sizes = [x["count"] for x in kept.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == n - n // 1000 and len(sizes) > 1 and max(sizes) < 0.6 * n
    last = words.retime(w, cuts, 600_000).orderBy(F.desc("pos")).first()
    assert (last.pos, last.start_ms) == (n - 1, (n - 1) * 100 - 60 * (n // 1000))
