"""Corpus pipeline: documents in, sharded training mix out.

Every stage judges each row by its own text, so these hold from end to end:

* Null and empty texts aren't toxic, hold no benchmark item and have no words. They are
  near-duplicates of each other: one row without words stays.
* Rows without an id take part like all others. Of near-duplicates the row with the
  smallest id stays, or any one where none has an id.
* Rows that share an id are judged apart; equal rows are near-duplicates.
* Of ties (equal ids and texts) one row stays; which one can't be told.
* Benchmark items of fewer than five words don't drop a document.
* Very long texts are worked on whole.
* Empty tables give an empty result; without labels nothing is rejected as toxic only if
  every score stays under one half, as documented in ``facetry.llm.toxicity``.
* Extra columns are carried along, whatever their names; the last stage adds ``shard`` and
  ``slot``, which replace columns so named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from facetry.llm import decontam, mixing, shuffle_shards, simhash, toxicity
from facetry.llm.common import settle, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest id stays."""
    return simhash.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights; rows repeat as the mix says."""
    return mixing.mix(docs)


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets its shard and slot in the shuffled order."""
    return shuffle_shards.shuffle_into_shards(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mix_stage),
    ("sharding", shard_stage),
]
#: Trained models and fingerprints are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = settle(stage(spark, docs, sf_dir), f"stage-{at}")
    return docs
