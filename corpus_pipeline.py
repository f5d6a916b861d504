"""A corpus from raw documents: toxicity, near-duplicates, benchmark passages, mixture, shards.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and
read again as the next stage's ``docs``.  All but the last return the columns of ``documents``.
Null, empty and blank texts are copies of each other, of which the near-duplicates leave one; the
mixture takes as many copies of it as of others of its source; empty tables pass; additional columns stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parcelweave.llm import decontamination, mixing, neardup, sharding, toxicity
from parcelweave.storage import discard, materialize, scope

SHARDS = 24


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject."""
    return toxicity.remove_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates (five-word shingles, similarity 0.8 or more; by SimHash, then MinHash, each link verified): that with the smallest id."""
    return neardup.deduplicate(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontamination.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture by weights 5, 2, 1 takes it."""
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its shard and its slot there."""
    return sharding.assign(docs, SHARDS, payload=tuple(c for c in docs.columns if c != "doc_id"))


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("mixture", mixture),
    ("shards", shards),
]

#: SQL can't express a learnt model or the search for near-duplicates; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, applied to ``documents``; what a stage has written and read is deleted when its result is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with scope() as own:
            docs = materialize(stage(spark, docs, sf_dir), name)
        discard(*before, *own[:-1])
        before = own[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
