"""Slides of the entities that a text mentions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators import intervals, lookups, render

CELL = 60_000


def mentioned(first_said: DataFrame, texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """first_said: (source_id, key, t), where the words of a key first stand in a row. texts: (source_id, text), lower case. lexicon: (k, type, key, name, len), a table of any size, k its order. Entities whose
    words are said and whose key the text holds, a person's anywhere, all others' between word edges: (source_id, k, type, key, name, len, t)."""
    held = lookups.held(texts, "source_id", "text", lexicon.select(F.col("key").alias("tag")))
    said = first_said.join(lexicon.select("k", "type", "key", "name", "len"), "key")
    both = said.join(held.withColumnRenamed("tag", "key"), ["source_id", "key"])
    return both.where("at_edges or type = 'person'").select("source_id", "k", "type", "key", "name", "len", "t")


def slides(found: DataFrame, gaps: DataFrame, types: Sequence[str], cap: int) -> DataFrame:
    """found: as mentioned gives it. Slides at the mentions, in the lexicon's order, into the gaps (source_id, start_ms, end_ms): a name counts once, by its first key (a person by each key); no two get the same span;
    ``cap`` at most, those of other types dropped after that; of those that overlap the earlier stays, of those with one start the first by the lexicon."""
    person = F.col("type") == "person"
    first = F.row_number().over(Window.partitionBy("source_id", person, F.when(person, F.col("key")).otherwise(F.col("name"))).orderBy("k"))
    want = found.withColumn("__r", first).where("__r = 1").select("source_id", F.col("k").cast("long").alias("entity"), "type", "name", F.col("t").alias("start_ms"), (F.col("t") + F.col("len")).alias("end_ms"))
    fitted = intervals.in_gap(want, gaps, "source_id", "entity", CELL).join(want.select("source_id", "entity", "type", "name"), ["source_id", "entity"])
    apart = fitted.groupBy("source_id", "start_ms", "end_ms").agg(F.min(F.struct("entity", "type", "name")).alias("x")).select("source_id", "start_ms", "end_ms", "x.*")
    placed = apart.withColumn("__place", F.row_number().over(Window.partitionBy("source_id").orderBy("entity"))).where((F.col("__place") <= cap) & F.col("type").isin(*types))
    named = placed.select("source_id", "start_ms", "end_ms", F.struct("entity", "type", "name").alias("slide"))
    first = render.first_at_start(named.select("source_id", "start_ms", "end_ms", F.col("slide.entity").alias("entity")), "source_id", "entity")
    kept = intervals.greedy(first, "source_id", "entity")
    return kept.join(named.select("source_id", "slide.*"), ["source_id", "entity"])
