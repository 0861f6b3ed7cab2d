"""Callouts and the hook on a clip's timeline: tracks and key frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Of each style the key frames' names, whether counted from the cue's end, offsets and lengths in ms.
KEY_FRAMES = {
    "punch": (("in", False, 0, 400), ("out", True, -350, 350)),
    "bigstat": (("in", False, 0, 300), ("eyebrow", False, 50, 450), ("number", False, 180, 600), ("subline", False, 550, 500), ("out", True, -400, 400)),
    "hero": (("in", False, 0, 550), ("out", True, -400, 400)),
    "caption": (("in", False, 0, 550), ("out", True, -400, 400)),
    "hook": (
        ("background", False, 0, 180), ("flash", False, 30, 120), ("flash-out", False, 180, 450), ("overline", False, 140, 420), ("headline", False, 200, 500), ("rule", False, 700, 450),
        ("out", True, -420, 420),
    ),
}
HOOK_TRACK, FIRST_TRACK = 9, 11
KEY_ROWS = [(style, *k) for style, keys in KEY_FRAMES.items() for k in keys]


def on_tracks(callouts: DataFrame, hooks: DataFrame, key: str, tie: str) -> DataFrame:
    """The hook of each clip at 0 on its own track, and callouts in order of time each on the next one. Both have (key, tie, style, color, start_ms, duration_ms); a
    hook's style and start are set here."""
    numbered = callouts.withColumn("track", F.row_number().over(Window.partitionBy(key).orderBy("start_ms", tie)) + FIRST_TRACK - 1)
    opening = hooks.withColumns({"style": F.lit("hook"), "start_ms": F.lit(0).cast("long"), "track": F.lit(HOOK_TRACK)})
    return numbered.unionByName(opening.select(*numbered.columns))


def key_frames(cues: DataFrame) -> DataFrame:
    """A row for each key frame of each cue, (name, at_ms, len_ms) beside its columns; at_ms on the clip's timeline. A style that isn't known is a caption's. A hook's
    overline is left out where the column ``overline`` is there and empty or null."""
    keys = cues.sparkSession.createDataFrame(KEY_ROWS, "style string, name string, tail boolean, off long, len_ms int")  # fixed, a few rows
    known = F.when(F.col("style").isin(*KEY_FRAMES), F.col("style")).otherwise("caption")
    each = cues.withColumn("__style", known).join(F.broadcast(keys.withColumnRenamed("style", "__style")), "__style")
    if "overline" in cues.columns:
        each = each.where("not (name = 'overline' and coalesce(overline, '') = '')")
    return each.withColumn("at_ms", F.col("start_ms") + F.when(F.col("tail"), F.col("duration_ms")).otherwise(0) + F.col("off")).drop("__style", "tail", "off")


def camera(clips: DataFrame) -> DataFrame:
    """clips: (..., duration_ms). The slow zoom in to the middle and out again: (name, at_ms, len_ms) beside the clip's columns."""
    half = F.expr("duration_ms div 2")
    rows = F.array(F.struct(F.lit("zoom-in").alias("name"), F.lit(0).cast("long").alias("at_ms"), half.alias("len_ms")), F.struct(F.lit("zoom-out").alias("name"), half.alias("at_ms"), (F.col("duration_ms") - half).alias("len_ms")))
    return clips.select(*clips.columns, F.inline(rows))
