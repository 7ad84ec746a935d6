"""Queries over the operators of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, exact_dedup, mixing, ngram_join, packing, quality_lm, quotation, secrets, substring_dedup, toxicity
from tidemark.llm.common import table


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_quotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotation.link_quotations(table(spark, sf_dir, "conversations"))


def quoted_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotation linking over the conversations as mails that quote: the table itself has no quotes."""
    return quotation.link_quotations(quotation.quoting(table(spark, sf_dir, "conversations")))


def op7_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lm.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_secrets": op3_secrets,
    "op4_nearest": op4_nearest,
    "op5_mixing": op5_mixing,
    "op6_quotation": op6_quotation,
    "quoted_replies": quoted_replies,
    "op7_quality_lm": op7_quality_lm,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_packing": op9_packing,
    "op10_toxicity": op10_toxicity,
}

ORACLES: dict[str, str] = {
    "op6_quotation": quotation.ORACLE,
    "quoted_replies": quotation.QUOTED_ORACLE,
    "op8_exact_dedup": exact_dedup.ORACLE,
}
