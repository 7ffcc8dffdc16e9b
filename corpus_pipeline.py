"""Corpus pipeline: toxicity, near duplicates, decontamination, mixing, token store.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return
the columns of documents. Near duplicates are counted as one of the ten operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyloom.llm import decontam, minhash, mixing, tokens, toxicity
from skyloom.llm.common import load, workspace, written


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that score as toxic."""
    return toxicity.without_toxic(docs, load(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return minhash.without_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a test item."""
    return decontam.without_contaminated(docs, load(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents, some of them twice, so that sources come near their target weights."""
    return mixing.mixed_sequence(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token store and return what its files say of each document."""
    return tokens.token_digests(docs)


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontamination", benchmark), ("mixing", mix), ("tokens", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage is written and read again; what the stages before it wrote is deleted."""
    docs = load(spark, sf_dir, "documents")
    with workspace() as keep:
        for name, stage in STAGES:
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        keep.append(docs)
    return docs
