"""Documents to training sequences: five stages, each written as Parquet and read again by the next one."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from cellset.llm.exact_dup import without_copies
from cellset.llm.mixing import mixture
from cellset.llm.near_dup import without_near_copies
from cellset.llm.packing import packed_documents
from cellset.llm.quality import accepted
from cellset.session import durable_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on ``labels``, doesn't reject."""
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts: the one with the largest id."""
    return without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of near copies (similarity 0.8 of word shingles): the one with the smallest id."""
    return without_near_copies(docs, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their target weights; a document that is taken twice is there twice."""
    return mixture(docs, refill=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    return packed_documents(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("MinHash near-dedup", near),
          ("mixing to target weights", mix), ("best-fit packing", pack)]
#: Neither the classifier nor the packing can be said in SQL; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = os.path.join(durable_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    for place, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{place}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
