"""Exact deduplication by two passes over a Bloom filter, in DataFrame functions alone.

The first pass counts how many rows hit each slot of a filter of bounded size;
slots hit twice form the filter of possibly repeated texts. The second pass
tests each row against it. Rows that it clears are unique for certain and pass
straight through; only the others shuffle, summed on the map side, and are
compared by the SHA-256 of the whole normalised text.

Texts are equal when identical after lower-casing A to Z; null counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, filter_bits, join_counted, packed, repeat_filter, with_flag

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Only A to Z change; ``lower`` may serve where all characters are single bytes."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    The largest id of a group stays; a null id counts as the smallest, a null
    text as empty. Of rows that repeat both id and text exactly one is kept.
    Very long texts are read whole. An empty table gives an empty result; other
    columns play no part, whatever their names.
    """
    rows = checkpoint(docs.select(F.col(id_col).alias("doc_id"), F.sha2(normalised(F.col(text_col)), 256).alias("text_sha256")))
    h = F.xxhash64("text_sha256")
    n = rows.count()
    bits = filter_bits(n)
    flagged = with_flag(rows, h, bits, repeat_filter(rows, h, bits), "_maybe")
    alone = flagged.filter(~F.col("_maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    # equal (text, id) pairs are one row with a count here, and rows again at the end
    same = flagged.filter("_maybe").groupBy("text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("_n"))
    best = same.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.sum("_n").alias("group_size")).withColumnRenamed("text_sha256", "_sha")
    joined = join_counted(same, best, [("text_sha256", "_sha")], "group_size", n).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_i") == 1)
    return alone.unionByName(joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: of equal texts the one with the largest id.

    A null id counts as the smallest, a null text as empty; very long texts are
    read whole. Rows that repeat an id break ties by a hash of all their
    columns, so reruns agree. Columns may have any name and any type. An empty
    table gives an empty result.
    """
    rows = packed(docs)
    text = F.col(f"row.{text_col}")
    h = F.xxhash64(F.lower(F.coalesce(text, F.lit(""))))  # coarser than the equality, so nothing equal is told apart
    bits = filter_bits(docs.count())
    flagged = with_flag(rows, h, bits, repeat_filter(rows, h, bits), "maybe")
    order = F.struct(F.col(f"row.{id_col}").alias("id"), F.xxhash64(F.to_json("row")).alias("tie"))
    best = flagged.filter("maybe").groupBy(F.sha2(normalised(text), 256).alias("sha")).agg(F.max_by("row", order).alias("row"))
    return flagged.filter(~F.col("maybe")).select("row.*").unionByName(best.select("row.*"))


ORACLE = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
