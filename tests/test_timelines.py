"""Words of timelines: how they are dealt and what is shuffled."""

import pytest
from pyspark.sql import functions as F

from spanloom.operators import words
from spanloom.plans import registry

DIR = "/root/testdata/sf0.001"


def dealt_texts(spark, monkeypatch, name):
    """However large the tables are: texts by source, for words and for what is made of them, and no words."""
    monkeypatch.setattr(words, "TASK_BYTES", 50_000)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    dealt = [x for x in plan.split("\n") if "Exchange " in x]
    assert len(dealt) == 2 and all("hashpartitioning(source_id#" in x and "REPARTITION_BY_NUM" in x for x in dealt)
    assert "regexp_extract_all" not in plan[plan.rindex("Exchange ") :]


def test_only_texts_are_shuffled(spark, monkeypatch):
    dealt_texts(spark, monkeypatch, "clean_timeline")


@pytest.mark.parametrize("name", ["clean_timeline", "cut_kinds", "merged_cuts"])
def test_words_are_sorted_once_for_cuts(spark, name):
    """By place once for all cuts, not again for pairs of fillers; kept words and what is cut before them come of one order."""
    plan = registry.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == {"clean_timeline": 4, "cut_kinds": 1, "merged_cuts": 2}[name]


def test_words_are_dealt_by_size(spark, monkeypatch):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.repeat(F.lit("abc "), 100).alias("text"))
    assert words.from_documents(docs).rdd.getNumPartitions() == 1
    monkeypatch.setattr(words, "TASK_BYTES", 4000)
    made = words.from_documents(docs)
    assert made.rdd.getNumPartitions() == 6 and made.count() == 5000
    assert words.from_documents(docs.where("doc_id < 0")).count() == 0


def test_pauses_stand_at_the_very_end(spark):
    """A separator of lines that is part of a word ends it, for the SQL as here; a pattern's $ would look past it."""
    docs = spark.createDataFrame([(1, "a. b.\u2028 c,\u2028 d, e")], "doc_id long, text string")
    w = words.from_documents(docs).orderBy("pos").collect()
    assert [y.start_ms - x.end_ms for x, y in zip(w, w[1:])] == [400, 40, 40, 250]
