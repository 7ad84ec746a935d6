"""The rules engine as column expressions: gates, sizing, exits, fills, intents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions import money


#: Features of a decision that come from the world, and those that come from the portfolio.
WORLD_KEYS = ("calendar_match", "move_bps", "median_dollar_volume", "atr", "n_items", "n_sources", "items_per_hour")
PORTFOLIO_KEYS = ("open_positions", "has_position", "equity_usd")


def overlaid(snapshots: DataFrame, portfolio: DataFrame, key: str) -> DataFrame:
    """Stored features with the portfolio's recomputed; the world's stay as they were, and so do those of keys that ``portfolio`` lacks."""
    new = [c for c in PORTFOLIO_KEYS if c in portfolio.columns and c in snapshots.columns]
    p = portfolio.select(F.col(key).alias("_k"), F.lit(True).alias("_there"), *[F.col(c).alias(f"_{c}") for c in new])
    j = snapshots.join(p, F.col(key) == F.col("_k"), "left")
    return j.withColumns({c: F.when(F.col("_there"), F.col(f"_{c}")).otherwise(F.col(c)) for c in new}).select(*snapshots.columns)


def replayed(snapshots: DataFrame, rules: dict = C.RULES, stored: str = "skip_reason") -> DataFrame:
    """Stored decisions decided again on their stored features: ``replay_reason`` beside the stored reason, and the outcome.

    Rows depend on nothing but themselves: portfolio features are those of the
    day, not of the replay. ``outcome`` is same, opened (the stored decision
    skipped), closed (it didn't), or other_reason.
    """
    again = screened(snapshots.withColumnRenamed(stored, "_stored"), rules)
    outcome = F.when(F.col("_stored").eqNullSafe(F.col("skip_reason")), "same").when(F.col("skip_reason").isNull(), "opened").when(F.col("_stored").isNull(), "closed").otherwise("other_reason")
    return again.withColumn("outcome", outcome).drop("gates", "n_failed").withColumnRenamed("skip_reason", "replay_reason").withColumnRenamed("_stored", stored)


def gates(rules: dict = C.RULES) -> Column:
    """Array of (gate, pass, observed, threshold) in order; values as text. A missing number fails its gate."""
    c, yes = F.col, F.lit(True)
    text = lambda x: x.cast("string")
    crypto = c("asset_class") == "crypto"
    none = F.lit(None).cast("string")
    shorts = bool(rules["allow_shorts"])
    flag = lambda on: F.lit("false") if on else none
    rows = [
        ("direction_actionable", (c("direction") == "bullish") | ((c("direction") == "bearish") & F.lit(shorts)), c("direction"), F.lit("bullish|bearish" if shorts else "bullish")),
        ("min_confidence", c("confidence") >= rules["min_confidence"], c("confidence"), F.lit(str(rules["min_confidence"]))),
        ("already_expected", ~c("already_expected") if rules["reject_already_expected"] else yes, c("already_expected"), flag(rules["reject_already_expected"])),
        ("calendar_match", ~c("calendar_match") if rules["reject_calendar_match"] else yes, c("calendar_match"), flag(rules["reject_calendar_match"])),
        ("event_type_whitelist", c("event_type").isin(*rules["event_types"]) if rules["event_types"] else F.lit(False), c("event_type"), F.lit(",".join(rules["event_types"]))),
        ("stale_move", F.abs("move_bps") <= rules["stale_move_max_bps"], c("move_bps"), F.lit(str(rules["stale_move_max_bps"]))),
        ("liquidity", crypto | (c("median_dollar_volume") >= rules["min_median_dollar_volume"]), c("median_dollar_volume"), F.when(~crypto, F.lit(str(rules["min_median_dollar_volume"])))),
        ("max_concurrent_positions", c("open_positions") < rules["max_positions"], c("open_positions"), F.lit(str(rules["max_positions"]))),
        ("no_existing_position", ~c("has_position"), c("has_position"), F.lit("false")),
    ]
    return F.array(*[F.struct(F.lit(g).alias("gate"), F.coalesce(ok, F.lit(False)).alias("pass"), text(seen).alias("observed"), bar.alias("threshold")) for g, ok, seen, bar in rows])


def screened(rows: DataFrame, rules: dict = C.RULES) -> DataFrame:
    """Add gates and skip_reason: the first gate that fails, null if none does."""
    out = rows.withColumn("gates", gates(rules))
    failed = F.filter("gates", lambda g: ~g["pass"])
    return out.withColumns({"skip_reason": F.get(failed, F.lit(0))["gate"], "n_failed": F.size(failed)})


def sized(rows: DataFrame, equity: float, rules: dict = C.RULES) -> DataFrame:
    """Add qty, notional and size_reason from columns atr and price: risk over stop distance, capped, truncated at eight decimals; whole shares of equities."""
    one = 10**money.SCALE
    units = lambda x: F.lit(int(round(x * one))).cast("decimal(38,0)")
    atr, price = money.scaled(F.col("atr")), money.scaled(F.col("price"))
    stop = money.mul_scaled(units(rules["atr_stop_multiple"]), atr)
    whole = lambda q: F.when(F.col("asset_class") == "crypto", q).otherwise((q - q % one).cast("decimal(38,0)"))
    ok_stop = F.coalesce(F.col("_stop") > 0, F.lit(False))
    risk, cap = units(equity * rules["risk_bps"] / 10_000), units(equity * rules["max_notional_share"])
    out = rows.withColumns({"_stop": stop, "_price": price})
    out = out.withColumn("_q", F.when(ok_stop, whole(money.div_scaled(risk, F.col("_stop")))))
    over = money.mul_scaled(F.col("_q"), F.col("_price")) > cap
    out = out.withColumn("_q", F.when(over, whole(money.div_scaled(cap, F.col("_price")))).otherwise(F.col("_q")))
    reason = F.when(~ok_stop, "atr_available").when(F.col("_q") <= 0, "position_too_small")
    good = reason.isNull()
    out = out.withColumns({"size_reason": reason, "qty": F.when(good, money.unscaled(F.col("_q"))), "notional": F.when(good, money.unscaled(money.mul_scaled(F.col("_q"), F.col("_price"))))})
    return out.drop("_stop", "_price", "_q")


def exit_reason(entry: Column, price: Column, is_long: Column, atr: Column, opened: Column, now: Column, hours: Column, rules: dict = C.RULES) -> Column:
    """stop_loss before take_profit before time_stop, null while the position stays; a distance of zero never fires."""
    gain = F.when(is_long, price - entry).otherwise(entry - price)
    stop = atr * rules["stop_atr_multiple"]
    out = F.when((stop > 0) & (-gain >= stop), "stop_loss")
    if rules["take_profit_atr_multiple"] is not None:
        take = atr * rules["take_profit_atr_multiple"]
        out = out.when((take > 0) & (gain >= take), "take_profit")
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(opened.cast("timestamp"))) / 3_600_000_000
    return out.when(age >= hours, "time_stop")


def exit_instants(positions: DataFrame, bars: DataFrame, rules: dict = C.RULES, reach_days: int = 3, strict: bool = True) -> DataFrame:
    """Add exit_ts, exit_price and exit_reason: the first bar after the opening at which a rule fires.

    Positions: position_id, instrument_id, opened_at, entry_price, is_long, atr,
    hours. A position's exit depends on itself alone, so all are found at once.
    No bar beyond the deadline counts, so a time stop needs one at that very
    instant; without ``strict`` the search for it goes on for ``reach_days``.

    Positions meet a row for each day with its extremes first, then the bars of
    four days at most: the opening's, the deadline's, the last one, and the
    first between them on which a rule is sure to fire.
    """
    end = F.col("opened_at") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("hours") * 60).cast("int"))
    last = end if strict else end + F.make_dt_interval(F.lit(reach_days))
    p = positions.withColumns({"_last": last, "_d0": F.to_date("opened_at"), "_de": F.to_date(end), "_d1": F.to_date(last)})
    b = bars.select("instrument_id", "ts", "close").withColumn("_day", F.to_date("ts"))
    extremes = b.groupBy("instrument_id", "_day").agg(F.min("close").alias("_lo"), F.max("close").alias("_hi"))
    worst = F.when(F.col("is_long"), F.col("_lo") - F.col("entry_price")).otherwise(F.col("entry_price") - F.col("_hi"))
    best = F.when(F.col("is_long"), F.col("_hi") - F.col("entry_price")).otherwise(F.col("entry_price") - F.col("_lo"))
    stop = F.col("atr") * rules["stop_atr_multiple"]
    hit = F.coalesce((stop > 0) & (-worst >= stop), F.lit(False))
    if rules["take_profit_atr_multiple"] is not None:
        take = F.col("atr") * rules["take_profit_atr_multiple"]
        hit = hit | F.coalesce((take > 0) & (best >= take), F.lit(False))
    day = F.col("_day")
    may = p.withColumn("_day", F.explode(F.sequence("_d0", "_d1"))).join(extremes, ["instrument_id", "_day"]).withColumn("_hit", hit).filter(F.col("_hit") | (day >= F.col("_de")))
    edge = day.isin(F.col("_d0"), F.col("_de"), F.col("_d1"))
    sure = F.min(F.when((F.col("_hit") | (day > F.col("_de"))) & ~edge, day))
    found = may.groupBy(F.col("position_id").alias("_p")).agg(F.array_union(F.collect_set(F.when(edge, day)), F.array_compact(F.array(sure))).alias("_days"))
    near = p.join(found, F.col("position_id") == F.col("_p")).withColumn("_day", F.explode("_days")).drop("_p", "_days", "_d0", "_de", "_d1")
    j = near.join(b, ["instrument_id", "_day"]).filter((F.col("ts") > F.col("opened_at")) & (F.col("ts") <= F.col("_last")))
    reason = exit_reason(F.col("entry_price"), F.col("close"), F.col("is_long"), F.col("atr"), F.col("opened_at"), F.col("ts"), F.col("hours"), rules)
    hit = j.withColumn("reason", reason).filter("reason IS NOT NULL").groupBy(F.col("position_id").alias("_p")).agg(F.min(F.struct("ts", "close", "reason")).alias("x"))
    out = positions.join(hit, F.col("position_id") == F.col("_p"), "left")
    return out.withColumns({"exit_ts": F.col("x.ts"), "exit_price": F.col("x.close"), "exit_reason": F.col("x.reason")}).drop("_p", "x")


def filled(side: Column, reference: Column, qty: Column, fee_bps: Column, slippage_bps: int = C.SLIPPAGE_BPS) -> tuple[Column, Column, Column]:
    """(price, qty, fee): adverse slippage and fee, exact, rounded half away from zero at six, eight and six decimals."""
    factor = F.when(side == "buy", F.lit(f"{1 + slippage_bps / 10_000:.4f}").cast("decimal(6,4)")).otherwise(F.lit(f"{1 - slippage_bps / 10_000:.4f}").cast("decimal(6,4)"))
    price = F.round(reference.cast("decimal(18,6)") * factor, 6).cast("decimal(18,6)")
    q = F.round(qty.cast("decimal(20,8)"), 8).cast("decimal(20,8)")
    # 18,6 times 16,8 keeps all digits; fees by exact division of basis points
    fee = F.round((price * q.cast("decimal(16,8)")).cast("decimal(34,14)").cast("decimal(28,10)") * (fee_bps.cast("decimal(6,0)") * F.lit("0.0001").cast("decimal(5,4)")).cast("decimal(9,4)"), 6).cast("decimal(18,6)")
    return price, q, fee


def client_order_id(decision_key: Column, attempt: Column | None = None) -> Column:
    """Deterministic id of an order; closes add the attempt."""
    text = decision_key if attempt is None else F.concat_ws(":", decision_key, attempt.cast("string"))
    return F.substring(F.sha2(text, 256), 1, 32)


def order_intents(decisions: DataFrame, orders: DataFrame, now: Column, hours: int = C.INTENT_HOURS) -> DataFrame:
    """Open decisions of the last hours without an order, as market orders with deterministic ids."""
    fresh = decisions.filter(F.col("action").isin("open_long", "open_short") & (F.col("decided_at") >= now - F.make_dt_interval(F.lit(0), F.lit(hours))))
    keyed = fresh.withColumn("client_order_id", client_order_id(F.col("decision_key")))
    side = F.when(F.col("action") == "open_long", "buy").otherwise("sell")
    return keyed.join(orders.select("client_order_id"), "client_order_id", "left_anti").select("client_order_id", "decision_key", "instrument_id", side.alias("side"), "qty", F.lit("market").alias("order_type"), F.lit("day").alias("tif"))


def may_trade(switch: str | None) -> bool:
    """Only ``run``, or no value at all, lets orders through."""
    return switch is None or switch.strip() == "run"
