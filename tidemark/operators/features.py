"""Features that decisions need: volatility, liquidity, velocity, calendar matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import constants as C


def calendar_match(rows: DataFrame, calendar: DataFrame, key: str, at: str, minutes: int = C.CALENDAR_MINUTES) -> DataFrame:
    """Add ``calendar_match``: an event of the row's instrument, or of none, within ``minutes`` either side, both ends included.

    An interval join on slots as long as the reach: a row meets its own slot
    and the two beside it, there only the events of its instrument and the
    times of events without one, and matches are reduced to keys before they
    return.
    """
    width = minutes * 60_000_000
    slot = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / width)
    probe = rows.select(F.col(key), "instrument_id", F.col(at).alias("_at")).withColumn("_slot", F.explode(F.array(*[slot(F.col("_at")) + i for i in (-1, 0, 1)])))
    cal = calendar.select(F.col("instrument_id").alias("_i"), F.col("scheduled_at").alias("_s")).distinct().withColumn("_slot", slot(F.col("_s")))
    near = F.abs(F.unix_micros(F.col("_at").cast("timestamp")) - F.unix_micros(F.col("_s").cast("timestamp"))) <= width
    own = probe.join(cal.filter("_i IS NOT NULL").withColumnRenamed("_slot", "_cs"), (F.col("instrument_id") == F.col("_i")) & (F.col("_slot") == F.col("_cs"))).filter(near)
    common = probe.join(cal.filter("_i IS NULL").select("_slot", "_s"), "_slot").filter(near)
    hits = own.select(F.col(key).alias("_k")).unionByName(common.select(F.col(key).alias("_k"))).distinct()
    return rows.join(hits, F.col(key) == F.col("_k"), "left").withColumn("calendar_match", F.col("_k").isNotNull()).drop("_k")


def true_range(by: list[str], ts: str = "ts") -> Column:
    before = F.lag("close").over(W.partitionBy(*by).orderBy(ts))
    return F.when(before.isNull(), F.lit(None)).otherwise(F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def wilder_atr(bars: DataFrame, lookback: int = C.RULES["atr_lookback"], by: str = "instrument_id", ts: str = "ts") -> DataFrame:
    """(instrument_id, n_bars, atr): mean of the first ranges, then Wilder's smoothing; null below lookback + 1 bars."""
    r = bars.withColumn("tr", true_range([by], ts)).groupBy(by).agg(F.count(F.lit(1)).alias("n_bars"), F.array_sort(F.collect_list(F.when(F.col("tr").isNotNull(), F.struct(ts, "tr")))).alias("a"))
    tr = F.transform("a", lambda x: x["tr"])
    seed = F.aggregate(F.slice(tr, 1, lookback), F.lit(0.0), lambda acc, x: acc + x) / lookback
    rest = F.slice(tr, lookback + 1, F.greatest(F.size("a") - lookback, F.lit(0)))
    atr = F.aggregate(rest, seed, lambda acc, x: (acc * (lookback - 1) + x) / lookback)
    return r.select(by, "n_bars", F.when(F.size("a") >= lookback, atr).alias("atr"))


def median_dollar_volume(bars: DataFrame, by: str = "instrument_id", ts: str = "ts", days: int = C.LIQUIDITY_DAYS, least: int = C.LEAST_LIQUIDITY_DAYS) -> DataFrame:
    """Median of close times volume over the last days that have a volume; null with too few."""
    n = F.row_number().over(W.partitionBy(by).orderBy(F.desc(ts)))
    last = bars.withColumn("_n", n).filter(F.col("_n") <= days)
    value = F.col("close") * F.col("volume")
    return last.groupBy(by).agg(F.count(value).alias("n_days"), F.when(F.count(value) >= least, F.median(value)).alias("median_dollar_volume"))


def velocity(items: DataFrame, by: list[str], at: str, minutes: int = 60) -> Column:
    """Rows of the same key in the last ``minutes`` up to and with the row's own time."""
    us = F.unix_micros(F.col(at).cast("timestamp"))
    return F.count(F.lit(1)).over(W.partitionBy(*by).orderBy(us).rangeBetween(-minutes * 60_000_000 + 1, 0))
