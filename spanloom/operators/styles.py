"""Styles by name, with a default row; windows in which captions yield; delays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_style(rows: DataFrame, style: str, styles: DataFrame, default: str) -> DataFrame:
    """rows, each with a struct ``look``: the row of styles (name, ...; names once each) that the column ``style`` names, or the default one's where it names none or is null; null only if
    there is no default row either."""
    named = styles.select(F.col("name").alias("__name"))
    known = rows.join(named, F.col(style) == F.col("__name"), "left").withColumn("__style", F.coalesce("__name", F.lit(default))).drop("__name")
    looks = styles.select(F.col("name").alias("__of"), F.struct(*styles.columns).alias("look"))
    return known.join(looks, F.col("__style") == F.col("__of"), "left").drop("__style", "__of")


def yields(overlays: DataFrame, slides: DataFrame) -> DataFrame:
    """(source_id, start_ms, end_ms, kind): overlays' windows, and those of slides that fill the frame (slides: with ``badge``); captions give way in them."""
    window = ["source_id", "start_ms", "end_ms"]
    full = slides.where(~F.coalesce("badge", F.lit(False)))
    return overlays.select(*window, F.lit("overlay").alias("kind")).unionByName(full.select(*window, F.lit("slide").alias("kind")))


def delay_ms(seconds: Column) -> Column:
    """Whole milliseconds, halves to even."""
    return F.rint(seconds * 1000).cast("long")
