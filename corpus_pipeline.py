"""A corpus pipeline of five stages, each of which calls one operator of tidemark.llm.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; its result is written as Parquet and read again as the next one's docs.

Documents may lack ids or repeat them: null and repeated ids, empty and very
long texts, equal rows and an empty table go as the operators' docstrings say.
All stages but the last keep the columns of documents, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from tidemark.llm.common import checkpoint_folder, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of the labelled rows rejects go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def exact_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    return exact_dedup.exact_dedup(docs)


def near_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the one with the least id stays."""
    return ngram_join.near_dedup(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences; a document that the mix repeats is packed each time."""
    return packing.pack(docs)


STAGES = [("toxicity", toxic_out), ("exact dedup", exact_once), ("near dedup", near_once), ("mixing", mixed), ("packing", packed)]

#: Boosted trees and a tokenizer have no SQL; tests hold the pipeline to a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what is between them is written to the shared checkpoint folder, and goes once the next stage is written."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{i - 1}")
            done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(done, True)
    return docs
