"""Texts in sections, as rows in order: a text of any length is written without a row or a task that has all of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.ranks import numbered


def sections(rows: DataFrame, section: str, order: Sequence[str], line: Column, head: Column) -> DataFrame:
    """(section, place, line_no, line): of each section its head (place 0; by way of ``n``, its rows), then its rows' lines in order; sections by name, nulls first. line_no counts from 0 over the whole text.
    The order should end with what makes it unique."""
    body = rows.select(F.col(section), F.lit(1).alias("__kind"), *order, line.alias("line"))
    heads = rows.groupBy(section).agg(F.count(F.lit(1)).alias("n")).select(section, F.lit(0).alias("__kind"), *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in order), head.alias("line"))
    placed = numbered(heads.unionByName(body), [section, "__kind", *order], "line_no")
    first = placed.where("__kind = 0").select(F.col(section).alias("__of"), F.col("line_no").alias("__first"))
    met = placed.join(first, F.col(section).eqNullSafe(F.col("__of")))
    return met.select(section, (F.col("line_no") - F.col("__first")).alias("place"), "line_no", "line")
