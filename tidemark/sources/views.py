"""Domain relations as views over the driver's tables.

Timestamps come without a zone and are read as UTC. Every view is a plain
DataFrame, so filters and column choices reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BENCHMARK = 0
EPOCH = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``k``, the number in their properties."""
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def bars_1m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute bars of eight instruments; errors are anchors and make no bars, nor do values that can't be prices."""
    e = table(spark, sf_dir, "events").filter((F.col("event_type") != "error") & (F.col("value") > 0))
    at = F.struct("ts", "event_id")
    grouped = e.withColumn("instrument_id", F.col("user_id") % 8).withColumn("minute", F.date_trunc("minute", "ts").cast("timestamp_ntz"))
    return grouped.groupBy("instrument_id", F.col("minute").alias("ts")).agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count(F.lit(1)).alias("volume"))


def bars_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute bars of weekdays from 14:00 to 20:59 only, so that there are gaps."""
    return bars_1m(spark, sf_dir).filter((F.weekday("ts") < 5) & F.hour("ts").between(14, 20))


def bars_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("instrument_id", F.col("o_custkey") % 8)
    return o.groupBy("instrument_id", F.col("o_orderdate").alias("ts")).agg(F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.max_by("o_totalprice", "o_orderkey").alias("close"), F.count(F.lit(1)).alias("volume"))


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories: when they were received, and when they claim to have been published."""
    e = events(spark, sf_dir).filter("event_type = 'error'")
    published = F.when(F.col("k") % 7 != 0, F.col("ts") - F.make_dt_interval(F.lit(0), F.lit(0), F.col("k") % 50))
    return e.select(F.col("event_id").alias("cluster_id"), (F.col("user_id") % 8).alias("instrument_id"), F.col("ts").alias("anchor_ts"), published.alias("published_ts"), "k")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled predictions."""
    e = events(spark, sf_dir).filter("event_type = 'purchase'")
    kinds = F.array(*[F.lit(x) for x in ("earnings", "guidance", "merger", "legal", "product")])
    sides = F.array(*[F.lit(x) for x in ("bullish", "bearish", "neutral")])
    return e.select(
        F.col("event_id").alias("signal_id"), (F.col("user_id") % 8).alias("instrument_id"), F.col("ts").alias("anchor_ts"), F.get(kinds, F.col("k") % 5).alias("event_type"), F.get(sides, F.col("k") % 3).alias("direction"), (F.col("k") / 100).alias("confidence"),
        F.least(F.col("value") / 200, F.lit(1.0)).alias("materiality"), (F.col("k") % 4 == 0).alias("already_expected"), F.when(F.col("user_id") % 8 >= 6, "crypto").otherwise("us_equity").alias("asset_class"), F.concat(F.lit("v"), (F.col("user_id") % 2 + 1).cast("string")).alias("prompt_version"), "value", "k",
    )


def scheduled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar; a null instrument stands for all."""
    e = events(spark, sf_dir).filter("event_type = 'signup' AND k % 20 = 0")
    return e.select(F.col("event_id").alias("sched_id"), F.when(F.col("k") % 40 != 0, F.col("user_id") % 8).alias("instrument_id"), F.col("ts").alias("scheduled_at"))


def news_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as news: the first line is the headline, received a minute after each other."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("item_id"), F.substring_index("text", "\n", 1).alias("headline"), F.col("text").alias("body"), "source", "lang", (F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("doc_id").cast("int"))).alias("received_at"))


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_partkey") % 50).alias("instrument_id"), F.when(F.col("l_returnflag") == "A", "sell").otherwise("buy").alias("side"), F.col("l_quantity").cast("decimal(20,8)").alias("qty"),
        F.round(F.col("l_extendedprice").cast("decimal(18,6)") / F.col("l_quantity").cast("decimal(18,6)"), 6).cast("decimal(18,6)").alias("price"), F.col("l_tax").cast("decimal(18,6)").alias("fee"), F.col("l_shipdate").alias("filled_at"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of validity; every third is open."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("member_id")).agg(F.min("l_shipdate").alias("valid_from"), F.max("l_shipdate").alias("valid_last")).select("member_id", "valid_from", F.when(F.col("member_id") % 3 != 0, F.col("valid_last")).alias("valid_to"))


def scored_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score in [0, 1] and whether it hit."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return lab.join(d.select("doc_id", "n_chars", "lang"), "doc_id").select("doc_id", "lang", ((F.col("n_chars") % 1000) / 1000).alias("score"), (F.col("quality") == 1).alias("hit"))
