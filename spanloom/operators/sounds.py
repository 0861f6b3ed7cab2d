"""Which sounds a clip gets, from its hook, its callouts and its words."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import params as P
from spanloom.functions import text as T
from spanloom.operators import intervals

MODES = ("off", "sparing", "every")


def sound_events(hooks: DataFrame, callouts: DataFrame, mentions: DataFrame, files: Mapping[str, int], mode: str = "sparing", swipe_out: bool = False, gains: Mapping[str, float] = P.SLOT_GAIN) -> DataFrame:
    """(source_id, t_ms, slot, gain, variant). hooks: (source_id) of the clips that open with one. callouts: (source_id, t, len, dur, ding), ding: a big
    figure, which is heard as such unless mode is off or there is no such sound; all others swipe in, and out too if that is wanted. mentions: (source_id, t, dur, slot, pos), words of a list by
    its slot; the first of each only in the sparing mode, none where it is off. A slot without a file never takes part, so it parts no repeats;
    of one slot's events less than SAME_EVENT apart the first stays. Variants take turns over a slot's files."""
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    have = {slot for slot, n in files.items() if n > 0}
    event = lambda slot, t: F.struct(t.cast("long").alias("t_ms"), F.lit(slot).alias("slot"))
    dings = F.col("ding") if mode != "off" and "ding" in have else F.lit(False)
    said = F.array_compact(
        F.array(
            F.when(dings, event("ding", F.col("t"))),
            F.when(~dings & F.lit("swipe-in" in have), event("swipe-in", F.col("t"))),
            F.when(F.lit(swipe_out and "swipe-out" in have), event("swipe-out", F.least(F.col("t") + F.col("len"), F.col("dur")))),
        )
    )
    every = callouts.select("source_id", F.inline(said))
    if "hook-impact" in have:
        every = every.unionByName(hooks.select("source_id", F.lit(50).cast("long").alias("t_ms"), F.lit("hook-impact").alias("slot")))
    if mode != "off":
        found = mentions.where(F.col("slot").isin(*sorted(have & {"cash-register", "wrong-answer"})))
        if mode == "sparing":
            found = found.withColumn("__k", F.row_number().over(Window.partitionBy("source_id", "slot").orderBy("pos"))).where("__k = 1")
        every = every.unionByName(found.where("t between 0 and dur").select("source_id", F.col("t").cast("long").alias("t_ms"), "slot"))
    kept = intervals.apart(every, "source_id")
    number = lambda of, other: T.lookup(F.col("slot"), {k: str(v) for k, v in of.items()}, other)
    order = Window.partitionBy("source_id", "slot").orderBy("t_ms")
    return kept.select("source_id", "t_ms", "slot", number(gains, "1.0").cast("double").alias("gain"), ((F.row_number().over(order) - 1) % number(files, "1").cast("int")).alias("variant"))
