"""What a scorer is shown: candidates, point-in-time contexts within budgets, checks of its answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Closed vocabularies: fixed values.
DIRECTIONS = ("bullish", "bearish", "neutral")
HORIZONS = ("intraday", "1d", "3d", "5d")
EVENT_TYPES = (
    "earnings_result", "guidance_update", "merger_acquisition", "ma_speculation", "executive_change", "analyst_action", "capital_return", "capital_raise", "restatement_accounting", "bankruptcy_restructuring",
    "impairment_writeoff", "delisting_compliance", "material_agreement", "legal_regulatory", "clinical_fda", "product_news", "insider_activity", "stake_disclosure", "other",
)
MACRO_EVENT_TYPES = (
    "monetary_policy", "fiscal_policy", "trade_policy", "macro_data", "currency_move", "geopolitical_conflict", "political_transition", "regulation_legal", "energy_supply", "commodity_supply",
    "supply_chain_disruption", "natural_event", "public_health", "labor_action", "technology_shift", "other",
)
SECTORS = ("Communication Services", "Consumer Discretionary", "Consumer Staples", "Energy", "Financials", "Health Care", "Industrials", "Information Technology", "Materials", "Real Estate", "Utilities")
MOST_COMPANIES, MOST_REASONING = 3, 600
#: Minutes after the anchor up to which a scorer sees items.
CONTEXT_MINUTES = 5
MOST_SECTORS, MOST_MOVE_BPS, MOST_MACRO_BPS, LEAST_MATERIALITY = 4, 5000, 2000, 0.1


def contexts(items: DataFrame, per_item: int, total: int, most: int = 3) -> DataFrame:
    """(cluster_id, n_items, context): the earliest items of a story as text.

    Items: cluster_id, item_id, headline, body, received_at, first_at. Each item
    is cut to ``per_item`` characters and all together to ``total``; a label
    tells how long after the first it came.
    """
    w = W.partitionBy("cluster_id").orderBy("received_at", "item_id")
    minutes = (F.unix_micros(F.col("received_at").cast("timestamp")) - F.unix_micros(F.col("first_at").cast("timestamp"))) / 60_000_000
    label = F.concat(F.lit("[+"), F.floor(minutes).cast("string"), F.lit("m] "))
    one = F.left(F.concat_ws(" — ", F.concat(label, F.col("headline")), F.nullif("body", F.lit(""))), F.lit(per_item))
    t = items.withColumns({"n": F.row_number().over(w), "t": one}).filter(F.col("n") <= most)
    before = F.coalesce(F.sum(F.length("t") + 1).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    t = t.withColumn("t", F.left("t", F.greatest(F.lit(total) - before, F.lit(0)).cast("int"))).filter("t <> ''")
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]), "\n")
    return t.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_items"), ordered.alias("context"))


def as_of(items: DataFrame, now: Column, minutes: int = CONTEXT_MINUTES) -> DataFrame:
    """Items (received_at, first_at) that a scorer may see: received at most so many minutes after the story began, and not after ``now``."""
    cut = F.least(F.col("first_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes)), now)
    return items.filter(F.col("received_at") <= cut)


def counts_as_of(items: DataFrame, lag_minutes: int) -> DataFrame:
    """(cluster_id, n_items, n_sources): how large stories were so many minutes after they began, not how large they turned out."""
    lag = F.unix_micros(F.col("received_at").cast("timestamp")) - F.unix_micros(F.col("first_at").cast("timestamp"))
    return items.filter(lag <= lag_minutes * 60_000_000).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_items"), F.count_distinct("source").alias("n_sources"))


def refused(event_type: Column, direction: Column, horizon: Column, move_bps: Column, materiality: Column, confidence: Column, reasoning: Column) -> Column:
    """Why a judgment of one company is refused, or null; a missing value is refused like one out of range."""
    in_range = lambda x, top: F.coalesce(x.between(0, top), F.lit(False))
    return (
        F.when(~F.coalesce(event_type.isin(*EVENT_TYPES), F.lit(False)), "event_type")
        .when(~F.coalesce(direction.isin(*DIRECTIONS), F.lit(False)), "direction")
        .when(~F.coalesce(horizon.isin(*HORIZONS), F.lit(False)), "horizon")
        .when(~in_range(move_bps, MOST_MOVE_BPS), "move_range")
        .when(~in_range(materiality, 1), "materiality_range")
        .when(~in_range(confidence, 1), "confidence_range")
        .when(~in_range(F.length(reasoning) - 1, MOST_REASONING - 1), "reasoning")
    )


def incoherent(scope: Column, sectors: Column, move_bps: Column, confidence: Column) -> Column:
    """Why a judgment is refused, or null. ``sectors`` is an array of (sector, materiality)."""
    names = F.transform(sectors, lambda s: s["sector"])
    return (
        F.when(~confidence.between(0, 1), "confidence_range")
        .when(~F.abs(move_bps).between(0, MOST_MACRO_BPS), "move_range")
        .when((scope == "none") & (F.size(sectors) > 0), "scope_none_with_sectors")
        .when((scope != "none") & (F.size(sectors) == 0), "scope_without_sectors")
        .when(F.size(sectors) > MOST_SECTORS, "too_many_sectors")
        .when(F.size(F.array_distinct(names)) < F.size(names), "duplicate_sector")
        .when(F.exists(names, lambda n: ~n.isin(*SECTORS)), "unknown_sector")
        .when((F.size(sectors) > 0) & ~F.exists(sectors, lambda s: s["materiality"] > LEAST_MATERIALITY), "none_material")
    )


def candidates(pairs: DataFrame, signals: DataFrame, attempts: DataFrame, version: str, most_attempts: int = 3) -> DataFrame:
    """Pairs (cluster_id, instrument_id) without a signal of a version and with failed attempts to spare."""
    keyed = pairs.withColumn("signal_key", F.concat_ws(":", F.col("cluster_id").cast("string"), F.col("instrument_id").cast("string"), F.lit(version)))
    spent = attempts.filter(F.col("attempts") >= most_attempts).select("signal_key")
    return keyed.join(signals.select("signal_key"), "signal_key", "left_anti").join(spent, "signal_key", "left_anti")
