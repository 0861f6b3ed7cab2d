"""Robust statistics by exact rank, with no task that sees more than a bounded part of a group.

A group of MOST rows or fewer is sorted as a stream. Of a larger one a mergeable sketch gives splitters; they only say into which cells its values are counted, so its error costs
balance and no exactness. The counts say in which cell a rank lies, and only that cell's distinct values, counted, are put in order.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.tables import written

#: Rows of a group that one task may sort.
MOST = 1 << 20
#: Cells of a larger group, and the sketch's accuracy.
CELLS = 64
ACCURACY = 1000


def _cell(value: Column, splitters: Column) -> Column:
    """Two for each splitter below the value, and one if it is one: a value that many rows have is a cell of its own."""

    def step(at: Column, by: Column) -> Column:
        to = at + by
        return F.when((to <= F.size(splitters)) & (F.get(splitters, to - 1) < value), to).otherwise(at)

    below = F.aggregate(F.array(*(F.lit(1 << k) for k in range(CELLS.bit_length() - 1, -1, -1))), F.lit(0), step)
    return 2 * below + F.coalesce(F.get(splitters, below) == value, F.lit(False)).cast("int")


def at_ranks(rows: DataFrame, group: Sequence[str], values: Sequence[str], ranks: Mapping[str, Column]) -> DataFrame:
    """(group, n, <value>_<rank> ...): of each group the values at ranks (from 1, in ascending order) that are given by way of ``n``, its rows without nulls; for each
    column of ``values`` apart; null where a group has no such rank. A column's n stands in n_<value>."""
    long = rows.select(*group, F.inline(F.array(*(F.struct(F.lit(v).alias("__of"), F.col(v).cast("double").alias("__v")) for v in values)))).where("__v is not null")
    by = [*group, "__of"]
    shares = F.array(*(F.lit(k / CELLS) for k in range(1, CELLS)))
    cut = long.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array_distinct(F.percentile_approx("__v", shares, F.lit(ACCURACY))).alias("__s"))
    wanted = cut.withColumn("__r", F.array(*(F.struct(F.lit(name).alias("rank"), rank.cast("long").alias("k")) for name, rank in ranks.items())))
    dealt = _meet(long, wanted.select(*by, "__s"), by).withColumn("__cell", _cell(F.col("__v"), F.col("__s"))).drop("__s")
    counts = dealt.groupBy(*by, "__cell").agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(*by).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most 2 CELLS rows a group
    places = counts.withColumn("__b", before)
    asked = _meet(places, wanted.select(*by, F.explode("__r").alias("__r")).select(*by, "__r.rank", "__r.k"), by).where("k > __b and k <= __b + c").select(*by, "__cell", "rank", (F.col("k") - F.col("__b")).alias("k"))
    # only cells that hold a rank, and each value of one once
    inside = _meet(dealt, asked.select(*by, "__cell").distinct(), [*by, "__cell"]).groupBy(*by, "__cell", "__v").agg(F.count(F.lit(1)).alias("c"))
    up_to = inside.withColumn("__u", F.sum("c").over(Window.partitionBy(*by, "__cell").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)))
    found = _meet(up_to, asked, [*by, "__cell"]).where("k <= __u and k > __u - c")
    flat = found.groupBy(*group).agg(*(F.max(F.when((F.col("__of") == v) & (F.col("rank") == r), F.col("__v"))).alias(f"{v}_{r}") for v in values for r in ranks))
    sizes = cut.groupBy(*group).agg(*(F.coalesce(F.max(F.when(F.col("__of") == v, F.col("n"))), F.lit(0)).alias(f"n_{v}") for v in values))
    return _meet(sizes, flat, list(group), "left")


def _meet(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """A join by columns that may be null; what else the right side has must have other names than the left's."""
    more = [c for c in right.columns if c not in on]
    other = right.select(*(F.col(c).alias(f"__j_{k}") for k, c in enumerate(on)), *more)
    same = [F.col(c).eqNullSafe(F.col(f"__j_{k}")) for k, c in enumerate(on)]
    return left.join(other, same, how).select(*left.columns, *more)


Ranks = Mapping[str, Column]


class Sorted:
    """What groups of a bounded size are asked: windows over each, one shuffle by group for all of them."""

    def __init__(self, by: Sequence[str]):
        self.by = list(by)

    def ranks(self, rows: DataFrame, flag: str, values: Sequence[str], ranks: Ranks, count: str) -> DataFrame:
        whole = Window.partitionBy(*self.by, flag)
        rows = rows.withColumn("n", F.count(F.lit(1)).over(whole))
        for v in values:
            rows = rows.withColumn("__k", F.row_number().over(whole.orderBy(v)))
            rows = rows.withColumns({f"{v}_{r}": F.max(F.when(F.col("__k") == rank, F.col(v))).over(whole) for r, rank in ranks.items()}).drop("__k")
        return rows.withColumnRenamed("n", count)

    def counts(self, rows: DataFrame, flag: str, count: str) -> DataFrame:
        return rows.withColumn(count, F.count_if(flag).over(Window.partitionBy(*self.by)))

    def medians(self, rows: DataFrame, values: Sequence[str], count: str) -> DataFrame:
        return rows.groupBy(*self.by).agg(F.count(F.lit(1)).alias(count), *(F.median(v).alias(v) for v in values))


class Split(Sorted):
    """What groups of any size are asked: exact ranks by cells; what they say, a row a group, is written and met by group."""

    def ranks(self, rows: DataFrame, flag: str, values: Sequence[str], ranks: Ranks, count: str) -> DataFrame:
        found = at_ranks(rows.where(flag), self.by, values, ranks).withColumnRenamed(f"n_{values[0]}", count)
        return _meet(rows, F.broadcast(written(found.drop(*(f"n_{v}" for v in values[1:])))), self.by, "left")

    def counts(self, rows: DataFrame, flag: str, count: str) -> DataFrame:
        return _meet(rows, F.broadcast(written(rows.groupBy(*self.by).agg(F.count_if(flag).alias(count)))), self.by, "left")

    def medians(self, rows: DataFrame, values: Sequence[str], count: str) -> DataFrame:
        middles = at_ranks(rows, self.by, values, {"a": F.floor((F.col("n") + 1) / 2), "b": F.floor(F.col("n") / 2) + 1})
        return middles.select(*self.by, F.col(f"n_{values[0]}").alias(count), *(((F.col(f"{v}_a") + F.col(f"{v}_b")) / 2).alias(v) for v in values))


def by_size(rows: DataFrame, by: Sequence[str], most: int, plan: Callable[[DataFrame, Sorted], DataFrame]) -> DataFrame:
    """plan's result over the groups of at most ``most`` rows and over the larger ones. There are less than a ``most``-th as many large groups as rows; where there are none, nothing else is planned."""
    large = written(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most).select(*by))
    if large.isEmpty():
        return plan(rows, Sorted(by))
    theirs = large.select(*(F.col(c).alias(f"__l_{k}") for k, c in enumerate(by)))
    same = [F.col(c).eqNullSafe(F.col(f"__l_{k}")) for k, c in enumerate(by)]
    met = lambda how: rows.join(F.broadcast(theirs), same, how)
    return plan(met("left_anti"), Sorted(by)).unionByName(plan(met("left_semi"), Split(by)))


def percentiles(df: DataFrame, group: str, value: str, shares: dict[str, float], most: int = MOST) -> DataFrame:
    """Of each group the values at index round(p (n - 1)), halves to even."""
    ranks = {name: F.bround(p * (F.col("n") - 1)).cast("long") + 1 for name, p in shares.items()}

    def plan(rows: DataFrame, asked: Sorted) -> DataFrame:
        if isinstance(asked, Split):
            return at_ranks(rows, [group], [value], ranks).select(group, *(F.col(f"{value}_{name}").cast(df.schema[value].dataType).alias(name) for name in shares))
        order = Window.partitionBy(group).orderBy(value)
        ranked = rows.withColumn("k", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(group)))
        return ranked.groupBy(group).agg(*(F.max(F.when(F.col("k") == rank, F.col(value))).alias(name) for name, rank in ranks.items()))

    return by_size(df.select(group, value).where(F.col(value).isNotNull()), [group], most, plan)


def robust_center(found: DataFrame, width: int, height: int, most: int = MOST) -> DataFrame:
    """found: (clip_id, cx, cy, h). Of each clip the median centre and height of detections that are large enough,
    near the largest and no outliers; of fewer filters where too few are left; and the crop window that suits it."""
    return by_size(found.select("clip_id", "cx", "cy", "h"), ["clip_id"], most, lambda rows, asked: _center(rows, asked, width, height))


def _center(d: DataFrame, asked: Sorted, width: int, height: int) -> DataFrame:
    d = asked.ranks(d.withColumn("p0", F.col("h") >= max(180.0, 0.08 * height)), "p0", ["h"], {"90": F.greatest(F.lit(1), F.floor(F.col("n") * 0.9))}, "m0")
    d = d.withColumn("p1", F.coalesce(F.col("p0") & (F.col("h") >= 0.7 * F.col("h_90")), F.lit(False)))
    d = asked.ranks(d, "p1", ["cx", "cy"], {"q1": F.floor(F.col("n") / 4) + 1, "q3": F.floor(3 * F.col("n") / 4) + 1}, "m1")
    reach = {a: 2.5 * F.greatest(F.col(f"{a}_q3") - F.col(f"{a}_q1"), F.lit(1.0)) for a in ("cx", "cy")}
    inside = [F.col(a).between(F.col(f"{a}_q1") - reach[a], F.col(f"{a}_q3") + reach[a]) for a in ("cx", "cy")]
    d = d.withColumn("p2", F.col("p1") & ((F.col("m1") < 6) | (inside[0] & inside[1])))
    d = asked.counts(asked.counts(d, "p0", "n0"), "p2", "n2")
    used = d.where(F.when(F.col("n2") >= 8, F.col("p2")).when(F.col("n0") >= 8, F.col("p0")).otherwise(F.lit(True)))
    m = asked.medians(used.select("clip_id", "cx", "cy", "h"), ["cx", "cy", "h"], "n_used")
    off = ~(F.col("cx").between(0.1 * width, 0.9 * width) & F.col("cy").between(0.1 * height, 0.9 * height))
    clamp = lambda c, size: F.greatest(F.lit(0.1 * size), F.least(F.col(c), F.lit(0.9 * size)))
    m = m.withColumn("x", F.when(off, clamp("cx", width)).otherwise(F.col("cx"))).withColumn("y", F.when(off, clamp("cy", height)).otherwise(F.col("cy")))
    m = m.withColumn("zoom", F.greatest(F.lit(1920 * 0.32) / F.col("h"), F.lit(max(1080 / width, 1920 / height))))
    m = m.withColumn("w", 1080.0 / F.col("zoom")).withColumn("hh", 1920.0 / F.col("zoom"))
    left = F.greatest(F.lit(0.0), F.least(F.col("x") - 540.0 / F.col("zoom"), width - F.col("w")))
    top = F.greatest(F.lit(0.0), F.least(F.col("y") - (1920 * 0.4) / F.col("zoom"), height - F.col("hh")))
    return m.select("clip_id", "n_used", "cx", "cy", "h", "zoom", *(F.bround(c).cast("long").alias(a) for a, c in (("crop_x", left), ("crop_y", top), ("crop_w", F.col("w")), ("crop_h", F.col("hh")))))
