"""The corpus pipeline: documents in, packed sequences out.

All stages: an empty table gives an empty result, columns beyond those of documents are passed on (but by the last stage), whatever their names, and
very long texts are taken whole. What a stage does with nulls, repeated rows and ties stands beside it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import decontam, packing, pii, quality, simhash
from spanloom.llm.common import stash, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a certified cutoff rejects go: null and empty texts too, since they have no words. A null lang is a stratum of its own. Repeated rows are judged alike, and all stay or go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id (nulls last; ties by hash). Null and blank texts are copies of each other, and of repeated rows one stays."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that lie in a benchmark window are cut out; the document stays, its n_chars counted anew. Null texts stay null. Repeated rows lose the same."""
    return decontam.remove(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it are generalised or removed, n_chars counted anew. Null texts stay null. Repeated rows count as one document and change alike; of spans that overlap the first one names the whole."""
    return pii.sanitise(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document, with its sequence and place there. A null or empty text is its closing id alone; repeated rows and null ids are packed each for itself."""
    import public_tokenizers

    return packing.op5(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("sequence_packing", sequence_packing),
]

#: Fingerprints, tokens and packing are beyond SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
