"""Running values along a key's rows that don't put a key into one task.

A key's rows are cut into slices, by a column that doesn't fall along the order (a cell of time, say). Within a slice a window keeps the running
value; of each slice one row, its total, is added up along the key; and what stands before a slice is joined back by key and slice. A key of many
rows is then as many tasks' work as it has slices, and the totals are a row a slice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Of each kind: the window's and the total's aggregate, and how what stood before meets what stands here.
KINDS = {
    "sum": (F.sum, F.sum, lambda before, here: F.coalesce(before + here, before, here)),
    "max": (F.max, F.max, lambda before, here: F.greatest(before, here)),
    "min": (F.min, F.min, lambda before, here: F.least(before, here)),
}


def running(rows: DataFrame, keys: Sequence[str], cell: Column, order: Sequence[str | Column], values: Mapping[str, tuple[str, Column]], inclusive: bool = True) -> DataFrame:
    """rows with a column for each of ``values``, name: (kind, value), the kind one of sum, max and min: the aggregate over the key's rows up to this one (without it,
    unless inclusive), nulls left out; null where there is none. ``cell`` must not fall along ``order`` and is null for no row; rows equal in all of the order share no defined order among them, so
    the order should be unique where that matters."""
    marked = rows.withColumn("__cell", cell).withColumns({f"__v_{name}": value for name, (_, value) in values.items()})
    totals = marked.groupBy(*keys, "__cell").agg(*(KINDS[kind][1](f"__v_{name}").alias(f"__t_{name}") for name, (kind, _) in values.items()))
    earlier = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, "__cell", *(KINDS[kind][0](f"__t_{name}").over(earlier).alias(f"__b_{name}") for name, (kind, _) in values.items()))
    within = Window.partitionBy(*keys, "__cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    here = marked.withColumns({f"__h_{name}": KINDS[kind][0](f"__v_{name}").over(within) for name, (kind, _) in values.items()})
    theirs = before.select(*(F.col(k).alias(f"__k_{i}") for i, k in enumerate(keys)), F.col("__cell").alias("__c"), *(f"__b_{name}" for name in values))
    same = [F.col(k).eqNullSafe(F.col(f"__k_{i}")) for i, k in enumerate(keys)]
    met = here.join(theirs, [*same, F.col("__cell") == F.col("__c")])
    made = [KINDS[kind][2](F.col(f"__b_{name}"), F.col(f"__h_{name}")).alias(name) for name, (kind, _) in values.items()]
    return met.select(*(c for c in rows.columns if c not in values), *made)
