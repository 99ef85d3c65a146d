"""A corpus pipeline of the operators: each stage takes what its predecessor kept.

All stages share the executors and their Python workers, so each hands rows to Python in small batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatstrata.llm import block_naming, decontaminate, packing, quality, simhash
from chatstrata.llm.common import table
from chatstrata.session import scratch_path, small_batches


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier, fitted on all labels, does not reject."""
    return quality.accepted(docs, quality.train(docs, table(small_batches(spark), sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (A-Z lower-cased): the one with the largest doc_id."""
    small_batches(spark)
    return block_naming.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: similar by five-word runs to 0.8 or more; the smallest doc_id stays."""
    small_batches(spark)
    return simhash.drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no benchmark item is found."""
    return decontaminate.drop_contaminated(docs, table(small_batches(spark), sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    small_batches(spark)
    packing_ = packing.pack_documents(docs)
    pieces = packing_.pieces.select("key", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pieces.join(packing_.placement, "key").drop("key")


STAGES = [
    ("quality_filter", quality_filter),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packed),
]

# Neither the classifier nor SimHash nor the packing is SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch_path(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
