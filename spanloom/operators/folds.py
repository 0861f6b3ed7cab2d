"""Folds along sorted rows, for what is sequential by nature: one pass, a state of fixed size a key, nothing gathered."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def along(rows: DataFrame, key: str, order: Sequence[str], uses: Sequence[str], name: str, kind: T.DataType, start: Callable[[], list], step: Callable) -> DataFrame:
    """rows with one more column: what step(state, *uses) gives for each row, in order; each key begins with the state start() and step may change it.
    The row number makes Spark deal and sort the rows (not anew, where they are dealt by the key already), and says where a key begins."""
    numbered = rows.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    names = [*rows.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start()
        for batch in batches:
            made = []
            for k, *values in zip(batch.column(batch.num_columns - 1).to_pylist(), *(batch.column(batch.schema.get_field_index(u)).to_pylist() for u in uses), strict=True):
                if k == 1:
                    state = start()
                made.append(step(state, *values))
            arrow = {T.BooleanType(): pa.bool_(), T.LongType(): pa.int64()}[kind]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, arrow)], names)

    return numbered.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, kind)]))
