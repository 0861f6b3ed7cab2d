"""Exact places in one order of a whole table, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Drawn rows a bucket, by which buckets are bounded.
DRAWN = 32


def _below(bounds: list[Column], key: Column) -> Column:
    """How many of the sorted bounds are no greater than the key, by halving."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    every, n = F.array(*bounds), len(bounds)

    def step(at: Column, by: Column) -> Column:
        to = at + by
        return F.when((to <= n) & (F.get(every, to - 1) <= key), to).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def numbered(rows: DataFrame, order: Sequence[str], name: str, buckets: int | None = None) -> DataFrame:
    """rows with their place, from 0, by the columns of ``order`` (ascending, nulls first; the last ones should make it unique: rows equal in all of them are
    numbered in any order, within one bucket). A bounded draw by a hash of the order (the least hashes, DRAWN a bucket) bounds the buckets; their
    counts, a number each, give every bucket what stands before it; and places within a bucket come of a window over the bucket."""
    spark = rows.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*order)
    drawn = rows.select(key.alias("key")).orderBy(F.xxhash64("key")).limit(DRAWN * buckets).orderBy("key").collect()
    kinds = [rows.schema[c].dataType for c in order]
    at = sorted({len(drawn) * k // buckets for k in range(1, buckets)}) if drawn else []
    bounds = [F.struct(*(F.lit(v).cast(t).alias(c) for v, t, c in zip(drawn[k].key, kinds, order, strict=True))) for k in at]
    dealt = rows.withColumn("__bucket", _below(bounds, key))
    sizes = {r["__bucket"]: r["count"] for r in dealt.groupBy("__bucket").count().collect()}  # a row a bucket
    before, total = [], 0
    for k in range(len(bounds) + 1):
        before.append(total)
        total += sizes.get(k, 0)
    within = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order)) - 1
    return dealt.withColumn(name, within + F.get(F.array(*(F.lit(b).cast("long") for b in before)), F.col("__bucket"))).drop("__bucket")
