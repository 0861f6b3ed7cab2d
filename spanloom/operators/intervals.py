"""Operators over half-open or closed intervals in whole milliseconds, by a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from spanloom.functions import params as P
from spanloom.operators import chains
from spanloom.operators.folds import along
from spanloom.operators.scan import running
from spanloom.operators.stats import Split, by_size

#: Time of a slice, where a key is cut into slices.
CELL_MS = 600_000


def merge(spans: DataFrame, key: str, tolerance: int = P.MERGE_GAP, cell_ms: int | None = None) -> DataFrame:
    """(key, start_ms, end_ms): spans that overlap or are no more than tolerance apart made one. With cell_ms a key's spans are cut into slices of so much time,
    so that a key of very many spans is many tasks' work; without it a key is one task's."""
    own = spans.select(key, "start_ms", "end_ms")
    if cell_ms:
        cell, order = F.floor(F.col("start_ms") / cell_ms), ["start_ms", "end_ms"]
        reached = running(own, [key], cell, order, {"__reach": ("max", F.col("end_ms"))}, inclusive=False)
        opened = reached.withColumn("__opens", F.when(F.coalesce(F.col("start_ms") > F.col("__reach") + tolerance, F.lit(True)), F.col("start_ms"))).drop("__reach")
        # an island is named by its start: starts of islands rise along the order
        named = running(opened, [key], cell, order, {"__island": ("max", F.col("__opens"))})
        return named.groupBy(key, F.col("__island").alias("start_ms")).agg(F.max("end_ms").alias("end_ms"))
    order = Window.partitionBy(key).orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("start_ms") > reach + tolerance, F.lit(True))
    grouped = own.withColumn("opens", opens.cast("int"))
    grouped = grouped.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(key, "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("island")


def free_gaps(windows: DataFrame, lengths: DataFrame, key: str, cell_ms: int | None = None) -> DataFrame:
    """lengths: (key, duration_ms). What the windows leave of [0, duration], if long enough, less a margin on both sides. cell_ms: as in merge."""
    ends = lengths.select(key, F.col("duration_ms").alias("start_ms"), F.lit(None).cast("long").alias("end_ms"))
    # the end stands last, whatever starts at it or beyond
    rows = windows.select(key, "start_ms", "end_ms", F.lit(0).alias("last")).unionByName(ends.withColumn("last", F.lit(1)))
    order = ["last", "start_ms", "end_ms"]
    if cell_ms:
        cell = F.when(F.col("last") == 1, F.lit((1 << 63) - 1)).otherwise(F.floor(F.col("start_ms") / cell_ms))
        reached = running(rows, [key], cell, order, {"reach": ("max", F.col("end_ms"))}, inclusive=False)
    else:
        reached = rows.withColumn("reach", F.max("end_ms").over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)))
    open_ = reached.withColumn("cursor", F.greatest(F.lit(0), F.coalesce("reach", F.lit(0))))
    kept = open_.where(F.col("start_ms") - F.col("cursor") >= P.FREE_GAP)
    return kept.select(key, (F.col("cursor") + P.FREE_MARGIN).cast("long").alias("start_ms"), (F.col("start_ms") - P.FREE_MARGIN).cast("long").alias("end_ms"))


def without_overlap(spans: DataFrame, others: DataFrame, keys: Sequence[str], cell_ms: int) -> DataFrame:
    """spans that overlap none of others (touching is no overlap). Both are cut into time cells, so the anti join has equal keys."""
    cells = lambda d: d.withColumn("cell", F.explode(F.expr(f"sequence(start_ms div {cell_ms}, greatest(start_ms, end_ms - 1) div {cell_ms})")))
    mine = cells(spans.withColumn("__span", F.struct(*spans.columns)))
    theirs = cells(others.select(*keys, "start_ms", "end_ms")).select(*keys, "cell", F.col("start_ms").alias("os"), F.col("end_ms").alias("oe"))
    hit = mine.join(theirs, [*keys, "cell"]).where("start_ms < oe and end_ms > os").select("__span").distinct()
    whole = spans.withColumn("__span", F.struct(*spans.columns))
    return whole.join(hit, "__span", "left_anti").drop("__span")


def in_gap(spans: DataFrame, gaps: DataFrame, key: str, span_id: str, cell_ms: int) -> DataFrame:
    """The first gap that has a span's middle, else its start, else its end; and the span fitted into it. Spans without one are dropped."""
    points = spans.select(key, span_id, "start_ms", "end_ms", F.posexplode(F.expr("array(start_ms + end_ms, 2 * start_ms, 2 * end_ms)")).alias("k", "t2")).withColumn("cell", F.expr(f"t2 div {2 * cell_ms}"))
    cut = gaps.select(key, F.col("start_ms").alias("ga"), F.col("end_ms").alias("gb")).withColumn("cell", F.explode(F.expr(f"sequence(ga div {cell_ms}, gb div {cell_ms})")))
    both = points.join(cut, [key, "cell"]).where("t2 between 2 * ga and 2 * gb")
    best = both.groupBy(key, span_id, "start_ms", "end_ms").agg(F.min(F.struct("k", "ga", "gb")).alias("g"))
    size = F.least(F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(P.FIT_LEAST)), F.lit(P.FIT_MOST), F.col("g.gb") - F.col("g.ga"))
    fitted = best.withColumn("size", size).withColumn("s", F.greatest(F.col("g.ga"), F.least(F.col("start_ms"), F.col("g.gb") - F.col("size"))))
    return fitted.select(key, span_id, F.col("s").cast("long").alias("start_ms"), (F.col("s") + F.col("size")).cast("long").alias("end_ms"))


def greedy(spans: DataFrame, key: str, span_id: str, most: int | None = None, cell_ms: int = CELL_MS) -> DataFrame:
    """From left to right, spans that don't begin before the last kept one ends. A key is one fold along its sorted rows; with ``most``, keys of more rows than that (counted first) are
    chains of pointers instead, many tasks' work."""
    own = spans.select(key, "start_ms", "end_ms", span_id)
    if most is not None:
        return by_size(own, [key], most, lambda rows, asked: chains.greedy(rows, key, span_id, cell_ms) if isinstance(asked, Split) else greedy(rows, key, span_id))

    def step(reach: list, start: int, end: int) -> bool:
        if reach[0] is not None and start < reach[0]:
            return False
        reach[0] = end
        return True

    return along(own, key, ["start_ms", "end_ms", span_id], ["start_ms", "end_ms"], "__kept", BooleanType(), lambda: [None], step).where("__kept").drop("__kept")


def apart(events: DataFrame, key: str, within: int = P.SAME_EVENT, most: int | None = None, cell_ms: int = CELL_MS) -> DataFrame:
    """events: (key, t_ms, slot, ...) in order of time and slot; one like the last kept, less than ``within`` after it, goes. most: as in greedy."""
    rest = [c for c in events.columns if c not in (key, "t_ms", "slot")]
    own = events.select(key, "t_ms", "slot", *rest)
    if most is not None:
        return by_size(own, [key], most, lambda rows, asked: chains.apart(rows, key, within, cell_ms) if isinstance(asked, Split) else apart(rows, key, within))

    def step(last: list, t: int, slot: str) -> bool:
        if last[0] is not None and last[1] == slot and t - last[0] < within:
            return False
        last[:] = t, slot
        return True

    return along(own, key, ["t_ms", "slot", *rest], ["t_ms", "slot"], "__kept", BooleanType(), lambda: [None, None], step).where("__kept").drop("__kept")
