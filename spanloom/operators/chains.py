"""Sequential choices along a key's rows as chains of pointers, for keys that no task should see whole.

What a fold keeps depends on the row kept last alone: each row points to the one that would be kept next if it were kept. Pointers come of running values by slices;
which rows the first one reaches is found by doubling: in round k jumps of 2^k rows, so that a chain of n rows takes log2(n) rounds. Everything stays in the JVM, and each
round's tables are written, so that a lost executor costs no round before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.scan import running
from spanloom.operators.tables import forget, written

AT = "__at"


def marked(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """rows with a struct that orders and names them; rows alike in all of the order are told apart."""
    twin = F.row_number().over(Window.partitionBy(key, *order).orderBy(order[0]))
    return rows.withColumn("__twin", twin).withColumn(AT, F.struct(*order, "__twin")).drop("__twin")


def first_from(rows: DataFrame, key: str, at: str, since: Column, cell_ms: int) -> DataFrame:
    """(key, __at, next): the first row, in order, whose ``at`` is ``since`` or later. rows: as marked, ``at`` their order's first column."""
    none = F.lit(None).cast(rows.schema[AT].dataType)
    points = rows.select(key, F.col(at).alias("__t"), F.lit(0).alias("__q"), F.col(AT).alias("__row"), none.alias("__own"))
    points = points.unionByName(rows.select(key, since.alias("__t"), F.lit(1).alias("__q"), none.alias("__row"), F.col(AT).alias("__own")))
    # from late to early, rows before questions of the same time
    seen = running(points, [key], -F.floor(F.col("__t") / cell_ms), [F.desc("__t"), "__q"], {"next": ("min", F.col("__row"))})
    return seen.where("__q = 1").select(key, F.col("__own").alias(AT), "next")


def neighbour(rows: DataFrame, key: str, at: str, cell_ms: int, value: Column | None = None, back: bool = False) -> DataFrame:
    """rows with ``next``: the least __at behind this one (of those for which value, an __at or null, is given), or with ``back`` the greatest before it."""
    cell, order, kind = (F.floor(F.col(at) / cell_ms), [F.col(AT)], "max") if back else (-F.floor(F.col(at) / cell_ms), [F.desc(AT)], "min")
    return running(rows, [key], cell, order, {"next": (kind, F.col(AT) if value is None else value)}, inclusive=False)


def chain(pointers: DataFrame, key: str) -> DataFrame:
    """pointers: (key, __at, next), next later than __at or null, a row for each row. (key, __at) of those that each key's first row reaches, itself included."""
    jumps = written(pointers)
    reached = written(jumps.groupBy(key).agg(F.min(AT).alias(AT)))
    while not (ahead := jumps.where("next is not null")).isEmpty():
        more = reached.join(ahead, [key, AT]).select(key, F.col("next").alias(AT))
        grown = written(reached.unionByName(more).distinct())
        then = ahead.select(key, F.col(AT).alias("next"), F.col("next").alias("__then"))
        doubled = written(ahead.join(then, [key, "next"]).select(key, AT, F.col("__then").alias("next")))
        forget(jumps, reached)
        jumps, reached = doubled, grown
    forget(jumps)
    return reached


def greedy(spans: DataFrame, key: str, span_id: str, cell_ms: int) -> DataFrame:
    """From left to right, spans that don't begin before the last kept one ends: as intervals.greedy, without a fold."""
    rows = written(marked(spans.select(key, "start_ms", "end_ms", span_id), key, ["start_ms", "end_ms", span_id]))
    # behind a span without length stands its neighbour; behind any other, what begins at its end or later is behind it in the order, too
    flat = neighbour(rows, key, "start_ms", cell_ms).where("end_ms <= start_ms").select(key, AT, "next")
    long = first_from(rows, key, "start_ms", F.col("end_ms"), cell_ms).join(rows.where("end_ms > start_ms").select(key, AT), [key, AT], "left_semi")
    return rows.join(chain(flat.unionByName(long), key), [key, AT], "left_semi").drop(AT)


def apart(events: DataFrame, key: str, within: int, cell_ms: int) -> DataFrame:
    """Events without those like the last kept one and less than ``within`` after it: as intervals.apart, without a fold."""
    rest = [c for c in events.columns if c not in (key, "t_ms", "slot")]
    rows = written(marked(events.select(key, "t_ms", "slot", *rest), key, ["t_ms", "slot", *rest]))
    before = neighbour(rows, key, "t_ms", cell_ms, back=True).select(key, "t_ms", "slot", AT, F.coalesce(F.col("next.slot") != F.col("slot"), F.lit(True)).alias("opens"))
    other = neighbour(before, key, "t_ms", cell_ms, F.when(F.col("opens"), F.col(AT))).select(key, AT, F.col("next").alias("other"))
    later = first_from(rows, key, "t_ms", F.col("t_ms") + within, cell_ms)
    pointers = other.join(later, [key, AT]).select(key, AT, F.least("other", "next").alias("next"))
    return rows.join(chain(pointers, key), [key, AT], "left_semi").drop(AT)
