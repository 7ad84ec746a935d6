"""Streams: idempotent ingestion, dedup by key, windows, clusters that close, story attachment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import sinks


def stamped(items: DataFrame, received: str = "received_at", backfill: tuple[str, ...] = (), source: str = "source", claimed: str = "published_at") -> DataFrame:
    """Add the time of receipt: now, but their own time for licensed backfill sources; such a row without one is an error."""
    late = F.col(source).isin(*backfill) if backfill else F.lit(False)
    own = F.when(F.col(claimed).isNotNull(), F.col(claimed).cast("timestamp")).otherwise(F.raise_error("a backfilled row needs its own time").cast("timestamp"))
    return items.withColumn(received, F.when(late, own).otherwise(F.current_timestamp()))


def parsed_or_kept(raw: DataFrame, column: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows that parse, rows that don't): one bad message doesn't stop the others."""
    p = raw.withColumn("_p", F.from_json(column, schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    good = p.filter("_p IS NOT NULL AND _p._bad IS NULL").select(*[c for c in raw.columns if c != column], "_p.*").drop("_bad")
    return good, p.filter("_p IS NULL OR _p._bad IS NOT NULL").select(*raw.columns)


def ingest(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str], available_now: bool = True) -> StreamingQuery:
    """Write a stream first-write-wins into a Parquet table. A batch that runs again adds nothing, so at-least-once input ends up once."""

    def write(batch: DataFrame, _: int) -> None:
        sinks.append_absent(batch, path, keys, order)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


def once(stream: DataFrame, keys: list[str], at: str, within: str = "48 hours") -> DataFrame:
    """Dedup in the stream's state; keys are forgotten after ``within``."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, at: str, by: list[str], length: str, slide: str | None = None, late: str = "1 hour", value: str = "value") -> DataFrame:
    """Counts and sums of event-time windows; rows later than ``late`` are left out."""
    w = F.window(at, length, slide) if slide else F.window(at, length)
    return stream.withWatermark(at, late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), *by, "n", "total")


def closing_groups(stream: DataFrame, at: str, by: list[str], gap: str = "48 hours", late: str = "1 hour") -> DataFrame:
    """Groups that close when nothing came for ``gap``: first and last time and count."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *by).agg(F.min(at).alias("first_ts"), F.max(at).alias("last_ts"), F.count(F.lit(1)).alias("n")).drop("w")


def within_budget(queue: DataFrame, cost: str, order: list[str], spent: float, cap: float) -> DataFrame:
    """The head of a queue that today's budget still pays for: a row is taken while what was spent before it is below the cap.

    The running sum is taken in ranges of the order, each by a task of its own,
    from the sums of the ranges before it.
    """
    from pyspark.sql import Window as W

    from tidemark.storage import checkpoint

    ranges = checkpoint(queue.repartitionByRange(*order)).withColumn("_range", F.spark_partition_id())
    sums = ranges.groupBy("_range").agg(F.sum(cost).alias("_sum"))
    earlier = F.coalesce(F.sum("_sum").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    sums = sums.select(F.col("_range").alias("_r"), earlier.alias("_earlier"))  # a row for each range
    within = F.coalesce(F.sum(cost).over(W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rows = ranges.withColumn("_within", within).join(F.broadcast(sums), F.col("_range") == F.col("_r"))
    return rows.filter(F.col("_earlier") + F.col("_within") + spent < cap).select(*queue.columns)


def due(queue: DataFrame, done: DataFrame, attempts: DataFrame, keys: list[str], cap: int, stale: Column | None = None) -> DataFrame:
    """Rows without a result (or with a stale one) and with fewer than ``cap`` failed attempts."""
    finished = done if stale is None else done.filter(~stale)
    spent = attempts.filter(F.col("attempts") >= cap)
    return queue.join(finished.select(*keys), keys, "left_anti").join(spent.select(*keys), keys, "left_anti")


def token_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Add cost_usd by model prices per million tokens; an unknown model is an error."""
    p = prices.select(F.col("model").alias("_m"), "input_per_m", "output_per_m")
    j = usage.join(F.broadcast(p), F.col("model") == F.col("_m"), "left")
    value = (F.col("input_tokens") * F.col("input_per_m") + F.col("output_tokens") * F.col("output_per_m")) / 1e6
    return j.withColumn("cost_usd", F.when(F.col("_m").isNotNull(), value).otherwise(F.raise_error(F.concat(F.lit("no price for model "), F.col("model"))).cast("double"))).drop("_m", "input_per_m", "output_per_m")


def record_tick(crypto, equity) -> None:
    """One tick of both recorders, callables that write what they fetch: equity's failure doesn't keep crypto's bars from being stored, and is raised after that."""
    crypto()
    equity()


#: Hours that a measurement is run over again, so that horizons which settle late are filled in: five days, three more to fall forward, and a day.
SETTLING_HOURS = 216


def settling(anchors: DataFrame, now: Column, clock: str = "anchor_ts", hours: int = SETTLING_HOURS) -> DataFrame:
    """Anchors to measure again at ``now``; rows that exist already are left as they are by the write."""
    return anchors.filter((F.col(clock) >= now - F.make_dt_interval(F.lit(0), F.lit(hours))) & (F.col(clock) <= now))
