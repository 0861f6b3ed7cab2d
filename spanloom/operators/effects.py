"""Detections of faces, and effects that overlap at a time."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def best_faces(detections: DataFrame, keys: Sequence[str], tie: Sequence[str], every: int = 5, least: float = 0.6) -> DataFrame:
    """detections: (*keys, frame, score, x, y, w, h, *tie), a box each. Of every so many frames the detection with the best score, if that is at least ``least``: (*keys, frame, cx, cy, h, score), the
    box's middle. Ties by the columns tie, which must be numbers, least first; of detections alike in these, too, the least box (x, y, w, h), so that the answer hangs on no order of rows."""
    order = F.struct("score", *((-F.col(c)).alias(f"__{c}") for c in (*tie, "x", "y", "w", "h")))
    best = detections.where(F.col("frame") % every == 0).groupBy(*keys, "frame").agg(F.max_by(F.struct("x", "y", "w", "h", "score"), order).alias("b"))
    return best.where(F.col("b.score") >= least).select(*keys, "frame", (F.col("b.x") + F.col("b.w") / 2.0).alias("cx"), (F.col("b.y") + F.col("b.h") / 2.0).alias("cy"), F.col("b.h").alias("h"), F.col("b.score").alias("score"))


def at_times(effects: DataFrame, times: DataFrame, key: str, fade: int, longest: int) -> DataFrame:
    """times (key, t), each with ``scale`` and ``opacity``. effects: (key, start_ms, len, strength, fades), none longer than longest. Scale: 1 and the largest of the bumps that overlap there, not their sum; opacity: the least of
    the windows that fade, 1 where none does. Effects and times meet by time cells."""
    cell = fade + longest
    spread = effects.select(key, "start_ms", "len", "strength", "fades").withColumn("__cell", F.explode(F.expr(f"sequence(cast(floor((start_ms - {fade}) / {cell}) as bigint), cast(floor((start_ms + len + {fade}) / {cell}) as bigint))")))
    both = times.withColumn("__cell", F.expr(f"cast(floor(t / {cell}) as bigint)")).join(spread, [key, "__cell"], "left")
    at, n = F.col("t") - F.col("start_ms"), F.col("len")
    bump = F.when(at.between(0, n), F.sin(F.lit(math.pi) * at / n) * 0.04 * F.col("strength"))
    local = F.when(F.col("fades") & (at > -fade) & (at < n + fade), F.when(at < 0, -at / fade).when(at > n, (at - n) / fade).otherwise(0.0))
    made = both.groupBy(key, "t").agg(F.max(bump).alias("__bump"), F.min(local).alias("__local"))
    return made.select(key, "t", (1 + F.coalesce("__bump", F.lit(0.0))).alias("scale"), F.coalesce("__local", F.lit(1.0)).alias("opacity"))


def zoom(share: Column, motion: Column) -> Column:
    """A slide's slow zoom at a share of its time: from 1.18 to 1 where the motion is out, else from 1 to 1.18."""
    return F.when(motion == "out", 1.18 - 0.18 * share).otherwise(1 + 0.18 * share)


def shift(share: Column, motion: Column) -> Column:
    """A slide's shift (x, y) in per cent at a share of its time: by 8 to the left, right, up or down, centred; none for other motions."""
    way = 8 * share - 4
    along = lambda less, more: F.when(motion == less, -way).when(motion == more, way).otherwise(0.0)
    return F.struct(along("left", "right").alias("x"), along("up", "down").alias("y"))
