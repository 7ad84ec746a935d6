"""Evaluation statistics: intervals, deciles, calibration error, rank correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Z95 = 1.96


def wilson(hits: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """(low, high) of a rate; null without observations."""
    ok = F.when(n > 0, n.cast("double"))
    p = hits / ok
    mid = p + z * z / (2 * ok)
    half = F.lit(z) * F.sqrt(p * (1 - p) / ok + z * z / (4 * ok * ok))
    return (mid - half) / (1 + z * z / ok), (mid + half) / (1 + z * z / ok)


def decile(score: Column, buckets: int = 10) -> Column:
    """Bucket of a score clamped to [0, 1]; 1 falls in the last."""
    return F.least(F.lit(buckets - 1), F.floor(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)) * buckets)).cast("int")


def calibration(scored: DataFrame, score: str = "score", hit: str = "hit", buckets: int = 10) -> DataFrame:
    """(bucket, n, hits, mean_score, rate, low, high) for every bucket, empty ones too."""
    got = scored.groupBy(decile(F.col(score), buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"), F.avg(score).alias("mean_score"))
    every = scored.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    out = every.join(got, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("hits", F.lit(0).cast("long")).alias("hits"), "mean_score")
    low, high = wilson(F.col("hits"), F.col("n"))
    return out.select("*", (F.col("hits") / F.when(F.col("n") > 0, F.col("n"))).alias("rate"), low.alias("low"), high.alias("high"))


def calibration_error(scored: DataFrame, score: str = "score", hit: str = "hit", buckets: int = 10) -> DataFrame:
    """One row: n and the error, weighted by bucket; null without rows."""
    c = scored.groupBy(decile(F.col(score), buckets).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("s"), F.avg(F.col(hit).cast("double")).alias("r"))
    return c.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"), (F.sum(F.col("n") * F.abs(F.col("s") - F.col("r"))) / F.sum("n")).alias("ece"))


def spearman(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Rank correlation with average ranks of ties; null below three rows or where either is constant.

    Ranks come from counts of distinct values, so a window runs over values and
    not over rows.
    """
    by = by or []
    df = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())

    def ranks(c: str) -> DataFrame:
        n = df.groupBy(*by, c).agg(F.count(F.lit(1)).alias("_n"))
        before = F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy(c).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        return n.select(*by, F.col(c), (before + (F.col("_n") + 1) / 2).alias(f"_r{c}"))

    both = df.join(ranks(x), [*by, x]).join(ranks(y), [*by, y]) if by else df.join(ranks(x), x).join(ranks(y), y)
    varied = (F.count(F.lit(1)) >= 3) & (F.min(f"_r{x}") < F.max(f"_r{x}")) & (F.min(f"_r{y}") < F.max(f"_r{y}"))
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.when(varied, F.try_divide(F.covar_pop(f"_r{x}", f"_r{y}"), F.stddev_pop(f"_r{x}") * F.stddev_pop(f"_r{y}"))).alias("rho"))


def max_drawdown(trades: DataFrame, start: float, by: list[str], at: list[str], pnl: str = "realized_usd") -> DataFrame:
    """Largest fall of realised equity from its running peak, in per cent."""
    w = W.partitionBy(*by).orderBy(*at).rowsBetween(W.unboundedPreceding, 0)
    t = trades.withColumn("_e", F.lit(float(start)) + F.sum(pnl).over(w)).withColumn("_p", F.greatest(F.lit(float(start)), F.max("_e").over(w)))
    return t.groupBy(*by).agg((F.max(F.when(F.col("_p") > 0, (F.col("_p") - F.col("_e")) / F.col("_p")).otherwise(0.0)) * 100).alias("max_drawdown_pct"))


def run_metrics(trades: DataFrame, start: float, by: list[str], order: list[str]) -> DataFrame:
    """Trades, wins, losses, rates, basis points, profit factor, drawdown and exposure-adjusted return."""
    notional = F.abs(F.col("qty") * F.col("entry_price")).cast("double")
    pnl = F.col("realized_usd").cast("double")
    span = (F.unix_micros(F.max("closed_at").cast("timestamp")) - F.unix_micros(F.min("opened_at").cast("timestamp"))) / 1000
    held = (F.unix_micros(F.col("closed_at").cast("timestamp")) - F.unix_micros(F.col("opened_at").cast("timestamp"))) / 1000
    exposure = F.sum(notional * held)
    losses = F.sum(F.when(pnl < 0, -pnl).otherwise(0.0))
    m = trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trades"), F.count_if(pnl > 0).alias("wins"), F.count_if(pnl < 0).alias("losses"), (F.count_if(pnl > 0) / F.count(F.lit(1))).alias("hit_rate"),
        F.avg(F.when(notional > 0, pnl / notional * 10_000)).alias("avg_bps"), F.when(losses > 0, F.sum(F.when(pnl > 0, pnl).otherwise(0.0)) / losses).alias("profit_factor"), F.round(F.sum(pnl), 2).alias("realized_usd"),
        F.when((span > 0) & (exposure > 0), F.sum(pnl) / (exposure / span) * 100).alias("exposure_return_pct"),
    )
    return m.join(max_drawdown(trades, start, by, order), by)
