"""Which of many tags a text holds, by containment: no pair of text and tag is looked at that isn't a hit."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tags of so many bytes together go to every worker as one automaton (some 50 bytes of memory a byte); a longer list is joined.
AUTOMATON_BYTES = 1 << 20
#: Neither letter, digit nor underscore: what stands at a word's edge.
EDGE = r"[^\pL\pN_]"


def _known(tags: DataFrame) -> DataFrame:
    """(tag, edges) once each; a tag that asks for word edges in one row and not in another asks for none."""
    edges = F.coalesce("edges", F.lit(False)) if "edges" in tags.columns else F.lit(False)
    return tags.select("tag", edges.alias("edges")).where("tag <> ''").groupBy("tag").agg(F.min("edges").alias("edges"))


def held(texts: DataFrame, key: str, text: str, tags: DataFrame, first: bool = False, most_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """(key, tag, at_edges): the tags that each text contains, once each, and whether one stands between word edges somewhere; with ``first`` (key, tag), the least of them alone. tags: (tag) and, if wanted, ``edges``, whether
    word edges must stand around it. key names a text. Null texts hold nothing; null and empty tags are none. A short list (its size is measured) is
    an automaton in each worker and a text is read once; a longer list meets whole substrings of its tags' lengths by equality."""
    known = _known(tags)
    (size,) = known.agg(F.sum(F.octet_length("tag"))).first()
    asked = texts.select(F.col(key), F.col(text).alias("__text")).where("__text is not null")
    return by_automaton(asked, known, first) if (size or 0) <= most_bytes else by_lengths(asked, known, first)


def _edge(text: str, at: int) -> bool:
    return not 0 <= at < len(text) or not (text[at] == "_" or unicodedata.category(text[at])[0] in "LN")


def by_automaton(texts: DataFrame, tags: DataFrame, first: bool) -> DataFrame:
    key = texts.columns[0]
    shared = texts.sparkSession.sparkContext.broadcast([(r.tag, r.edges) for r in tags.collect()])  # measured
    made: dict[str, Any] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            import ahocorasick

            made["a"] = ahocorasick.Automaton()
            for tag, edges in shared.value:
                made["a"].add_word(tag, (tag, edges))
            if len(made["a"]):
                made["a"].make_automaton()
        automaton = made["a"]
        for batch in batches:
            rows, found = [], []
            for k, text in enumerate(batch.column(1).to_pylist() if len(automaton) else ()):
                hits: dict[str, bool] = {}
                for end, (tag, edges) in automaton.iter(text):
                    if not hits.get(tag):
                        at = _edge(text, end - len(tag)) and _edge(text, end + 1)
                        if at or not edges:
                            hits[tag] = at
                if first and hits:
                    least = min(hits, key=str.encode)
                    hits = {least: hits[least]}
                rows += [k] * len(hits)
                found += hits.items()
            if rows:
                columns = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.bool_())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *columns], [key, "tag", "at_edges"])

    made_rows = texts.mapInArrow(run, T.StructType([texts.schema[key], T.StructField("tag", T.StringType()), T.StructField("at_edges", T.BooleanType())]))
    return made_rows.drop("at_edges") if first else made_rows


def met(texts: DataFrame, tags: DataFrame) -> DataFrame:
    """(key, tag, at_edges, edges) of the whole substrings that are tags, a row for each place."""
    key = texts.columns[0]
    lengths = [r.n for r in tags.select(F.length("tag").alias("n")).distinct().collect()]  # as many as the longest tag has characters
    # an array of characters: substring() would count from the text's begin each time
    cut = texts.select(key, F.split("__text", "").alias("__c")).withColumn("__n", F.size("__c"))
    places = cut.select(key, "__c", "__n", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>")).alias("__l")).where("__l <= __n")
    edge = lambda at: F.coalesce(F.get("__c", at).rlike(EDGE), F.lit(True))
    each = F.transform(F.sequence(F.lit(0), F.col("__n") - F.col("__l")), lambda i: F.struct(F.array_join(F.slice("__c", i + 1, F.col("__l")), "").alias("tag"), (edge(i - 1) & edge(i + F.col("__l"))).alias("at_edges")))
    seen = places.select(key, F.explode(each).alias("s")).select(key, "s.*")
    return seen.join(tags, "tag")


def by_lengths(texts: DataFrame, tags: DataFrame, first: bool) -> DataFrame:
    key = texts.columns[0]
    hits = met(texts, tags).where("at_edges or not edges")
    return hits.groupBy(key).agg(F.min("tag").alias("tag")) if first else hits.groupBy(key, "tag").agg(F.max("at_edges").alias("at_edges"))
