"""Stories over a stream: each micro-batch is attached to the leaders that are still open.

The order of arrival matters to all later items, so there is one writer; a
batch is worked through in groups of linked items, in parallel. The state is a
table of leaders: leader_id, title, content_hash, started_at, last_item_at,
ciks and counters. A batch that runs again changes nothing, because items that
have a story already are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions import text as X
from tidemark.operators import similarity


def open_leaders(members: DataFrame, now: Column, hours: int = C.CLUSTER_HOURS) -> DataFrame:
    """Leaders of stories whose last item isn't older than ``hours``. Members: item_id, leader_id, title, content_hash, received_at, cik."""
    last = members.groupBy(F.col("leader_id").alias("_l")).agg(F.max("received_at").alias("_last"), F.max("cik").alias("_cik")).filter(F.col("_last") >= now - F.make_dt_interval(F.lit(0), F.lit(hours)))
    return members.filter("item_id = leader_id").join(last, F.col("item_id") == F.col("_l")).withColumn("cik", F.coalesce("cik", "_cik")).drop("_l", "_last", "_cik", "leader_id")


def closed(members: DataFrame, now: Column, hours: int = C.CLUSTER_HOURS) -> DataFrame:
    """(leader_id, n_items, n_sources, closed_at) of stories that nothing came to for ``hours``."""
    g = members.groupBy("leader_id").agg(F.count(F.lit(1)).alias("n_items"), F.countDistinct("source").alias("n_sources"), F.max("received_at").alias("last_item_at"))
    reach = F.make_dt_interval(F.lit(0), F.lit(hours))
    return g.filter(F.col("last_item_at") < now - reach).withColumn("closed_at", F.col("last_item_at") + reach)


def attach(batch: DataFrame, members: DataFrame, now: Column, hours: int = C.CLUSTER_HOURS, threshold: float = C.SIMILARITY) -> DataFrame:
    """(item_id, leader_id, similarity) of the batch's new items. Both tables: item_id, title, content_hash, received_at, cik; members also leader_id."""
    fields = ["item_id", "title", "content_hash", "received_at", "cik"]
    new = batch.join(members.select("item_id"), "item_id", "left_anti").select(*fields)
    every = open_leaders(members, now, hours).select(*fields).unionByName(new)
    pairs = similarity.similar_sets(every.withColumn("g", X.trigrams(F.col("title"))), "item_id", "g", threshold, "received_at", hours)
    got = similarity.leader_clusters(every.select("item_id", "content_hash", "received_at", "cik"), pairs, hours)
    return got.join(new.select("item_id"), "item_id", "left_semi")
