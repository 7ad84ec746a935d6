"""Intervals: coalescing, expansion, point-in-time validity, differences of versioned sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import constants as C


def coalesce(windows: DataFrame, by: list[str], start: str = "from_ts", end: str = "to_ts") -> DataFrame:
    """Overlapping and touching windows of a key become one; a window that ends before it starts is an error."""
    checked = windows.withColumn(end, F.when(F.col(end) >= F.col(start), F.col(end)).when(F.col(end).isNotNull(), F.raise_error("a window ends before it starts").cast(dict(windows.dtypes)[end])))
    w = W.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    island = F.sum(F.when(F.col(start) <= F.col("_reach"), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0))
    grouped = checked.withColumn("_reach", reach).withColumn("_island", island).groupBy(*by, "_island")
    return grouped.agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("_island")


def around(ts: Column, before_hours: int = C.FETCH_BEFORE_HOURS, after_days: int = C.FETCH_AFTER_DAYS) -> tuple[Column, Column]:
    """The window in which an event's bars are fetched."""
    return ts - F.make_dt_interval(F.lit(0), F.lit(before_hours)), ts + F.make_dt_interval(F.lit(after_days))


def valid_at(ts: Column, start: Column, end: Column) -> Column:
    """Half open; a null end is open."""
    return (start <= ts) & (end.isNull() | (end > ts))


def set_changes(current: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change): what is to be opened and what is to be closed."""
    opened = wanted.select(*keys).distinct().join(current.select(*keys), keys, "left_anti").withColumn("change", F.lit("open"))
    closed = current.select(*keys).distinct().join(wanted.select(*keys), keys, "left_anti").withColumn("change", F.lit("close"))
    return opened.unionByName(closed)


def apply_versions(history: DataFrame, wanted: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """A history (keys, valid_from, valid_to) after ``wanted`` became the open set at ``now``: rows close or open, none is rewritten otherwise."""
    open_rows = history.filter("valid_to IS NULL")
    gone = open_rows.join(wanted.select(*keys).distinct(), keys, "left_anti").withColumn("valid_to", now.cast(dict(history.dtypes)["valid_to"]))
    kept = open_rows.join(wanted.select(*keys).distinct(), keys, "left_semi")
    new = wanted.select(*keys).distinct().join(open_rows.select(*keys), keys, "left_anti").withColumns({"valid_from": now.cast(dict(history.dtypes)["valid_from"]), "valid_to": F.lit(None).cast(dict(history.dtypes)["valid_to"])})
    return history.filter("valid_to IS NOT NULL").unionByName(gone).unionByName(kept).unionByName(new)


def bar_universe(instruments: DataFrame, members: DataFrame, at: Column, benchmark: str) -> DataFrame:
    """Instruments (instrument_id, symbol, asset_class) whose bars are needed at a time, once each: members of then, all crypto, and the benchmark."""
    now = members.filter(valid_at(at, F.col("valid_from"), F.col("valid_to"))).select("instrument_id").distinct()
    extra = (F.col("asset_class") == "crypto") | ((F.col("symbol") == benchmark) & (F.col("asset_class") == "us_equity"))
    every = instruments.join(now, "instrument_id", "left_semi").unionByName(instruments.filter(extra))
    return every.dropDuplicates(["instrument_id"])


def calendar(fetched: DataFrame, symbols: DataFrame, now: Column, horizon_days: int = 90, backfill_from: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, counts) of fetched events: event_key, kind, symbol (null: concerns all), scheduled_at.

    Rows lie between a day before ``now``, or an earlier ``backfill_from``, and
    the horizon, the first of each key; those more than a day past are
    ``backfilled``, as nobody knew them before. Counts are of the rows left
    out: outside, duplicates, and not_members, whose symbol isn't in
    ``symbols`` (symbol, instrument_id).
    """
    grace = now - F.make_dt_interval(F.lit(1))
    since = grace if backfill_from is None else F.least(grace, backfill_from)
    known = symbols.select(F.col("symbol").alias("_s"), "instrument_id")
    e = fetched.join(known, F.upper(F.replace("symbol", F.lit("-"), F.lit("."))) == F.col("_s"), "left").drop("_s")
    w = W.partitionBy("event_key").orderBy("scheduled_at", F.col("symbol").asc_nulls_first())
    at = F.col("scheduled_at")
    why = F.when(F.col("symbol").isNotNull() & F.col("instrument_id").isNull(), "not_members").when((at < since) | (at > now + F.make_dt_interval(F.lit(horizon_days))), "outside")
    e = e.withColumn("_why", why)
    first = e.filter("_why IS NULL").withColumn("_n", F.row_number().over(w))
    rows = first.filter("_n = 1").select("event_key", "kind", "instrument_id", "scheduled_at", (at < grace).alias("backfilled"))
    left = e.filter("_why IS NOT NULL").select("_why").unionByName(first.filter("_n > 1").select(F.lit("duplicates").alias("_why")))
    counts = left.agg(*[F.count_if(F.col("_why") == k).alias(k) for k in ("outside", "duplicates", "not_members")])
    return rows, counts


def extended(minute: DataFrame, daily: DataFrame) -> DataFrame:
    """Minute closes followed by daily ones: a day's close counts at the day's end, and only past the last minute bar."""
    last = minute.groupBy(F.col("instrument_id").alias("_i")).agg(F.max("ts").alias("_last"))
    d = daily.select("instrument_id", (F.col("ts") + F.make_dt_interval(F.lit(1))).alias("ts"), "close").join(last, F.col("instrument_id") == F.col("_i")).filter("ts > _last")
    return minute.select("instrument_id", "ts", "close").unionByName(d.select("instrument_id", "ts", "close"))


def seeded(spark, rows: list[tuple[str, str]], since: str = "2020-01-01") -> DataFrame:
    """A curated list of (symbol, name) as open-ended membership."""
    df = spark.createDataFrame(rows, "symbol string, name string")
    return df.select("symbol", "name", F.lit(since).cast("timestamp_ntz").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
