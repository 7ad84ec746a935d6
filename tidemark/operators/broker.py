"""A simulated broker over tables: placing once, account state, exits of open positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.operators import decide
from tidemark.operators.asof import asof


def place(intents: DataFrame, orders: DataFrame, bars: DataFrame, now: Column) -> DataFrame:
    """New orders with their fills: one for each client_order_id that has none yet.

    Without a bar of the last day an order is rejected. Intents: client_order_id,
    instrument_id, side, qty, asset_class.
    """
    new = intents.dropDuplicates(["client_order_id"]).join(orders.select("client_order_id"), "client_order_id", "left_anti").withColumn("placed_at", now)
    priced = asof(new, bars, ["instrument_id"], "placed_at", name="bar", max_age_hours=C.QUOTE_AGE_HOURS)
    fee_bps = F.when(F.col("asset_class") == "crypto", C.FEE_BPS["crypto"]).otherwise(C.FEE_BPS["us_equity"])
    price, qty, fee = decide.filled(F.col("side"), F.col("bar.close"), F.col("qty"), fee_bps)
    ok = F.col("bar").isNotNull()
    status = F.when(ok, "filled").otherwise("rejected")
    return priced.select("client_order_id", "instrument_id", "side", "placed_at", status.alias("status"), F.when(ok, price).alias("fill_price"), F.when(ok, qty).alias("fill_qty"), F.when(ok, fee).alias("fee"))


def account(fills: DataFrame, bars: DataFrame, now: Column, starting_cash: float) -> DataFrame:
    """One row: cash, market value and equity; positions are net quantities at their last bar, whatever its age. One without a bar has cash but no value."""
    sign = F.when(F.col("side") == "buy", 1).otherwise(-1)
    book = fills.groupBy("instrument_id").agg(F.sum(sign * F.col("qty")).alias("qty"), F.sum(-sign * F.col("qty") * F.col("price") - F.col("fee")).alias("cash")).withColumn("now", now)
    marked = asof(book, bars, ["instrument_id"], "now", name="bar")
    value = F.coalesce(F.sum(F.col("qty").cast("double") * F.col("bar.close")), F.lit(0.0))
    return marked.agg((F.lit(float(starting_cash)) + F.sum("cash").cast("double")).alias("cash_usd"), value.alias("market_value_usd")).withColumn("equity_usd", F.col("cash_usd") + F.col("market_value_usd"))


def manage(positions: DataFrame, bars: DataFrame, attempts: DataFrame, now: Column, rules: dict = C.RULES) -> DataFrame:
    """(position_id, outcome, reason): held, closed, suppressed (too many attempts) or skipped (no quote of the last day)."""
    q = asof(positions.withColumn("now", now), bars, ["instrument_id"], "now", name="q", max_age_hours=C.QUOTE_AGE_HOURS)
    reason = decide.exit_reason(F.col("entry_price"), F.col("q.close"), F.col("is_long"), F.col("atr"), F.col("opened_at"), F.col("now"), F.col("hours"), rules)
    tried = attempts.select(F.col("position_id").alias("_p"), "attempts")
    j = q.withColumn("reason", F.when(F.col("q").isNotNull(), reason)).join(tried, F.col("position_id") == F.col("_p"), "left")
    outcome = F.when(F.col("q").isNull(), "skipped").when(F.col("reason").isNull(), "held").when(F.col("attempts") >= C.CLOSE_ATTEMPTS, "suppressed").otherwise("closed")
    return j.select("position_id", outcome.alias("outcome"), "reason")
