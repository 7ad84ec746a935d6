"""Decision, execution and portfolio queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions import stats
from tidemark.operators import decide, features, portfolio, study
from tidemark.operators.asof import asof
from tidemark.plans.evaluation import CALENDAR
from tidemark.plans.sql import with_views
from tidemark.sources import views as V

QUERIES, ORACLES = {}, {}
RULES = C.RULES | {"min_confidence": 0.5, "event_types": ("earnings", "merger", "product"), "stale_move_max_bps": 12_000.0, "min_median_dollar_volume": 100_000.0, "allow_shorts": True, "take_profit_atr_multiple": 3}
LAG_MINUTES = 10


def query(views: str, sql: str | None, recursive: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(views, sql, recursive) if views else sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


def n():
    return F.count(F.lit(1)).alias("n")


def world(spark, sf) -> DataFrame:
    """Signals with the features that depend on nothing else decided: quote, move, liquidity, calendar, volatility."""
    bars = V.bars_1m(spark, sf)
    s = features.calendar_match(V.signals(spark, sf), V.scheduled_events(spark, sf), "signal_id", "anchor_ts")
    s = s.withColumn("decision_at", F.col("anchor_ts") + study.minutes(LAG_MINUTES)).withColumn("before", F.col("anchor_ts") - study.minutes(1))
    s = asof(s, bars, ["instrument_id"], "before", name="a")
    s = asof(s, bars, ["instrument_id"], "decision_at", name="q")
    daily = V.bars_1d(spark, sf)
    per = features.median_dollar_volume(daily).select("instrument_id", "median_dollar_volume").join(features.wilder_atr(daily).select("instrument_id", (F.round(F.col("atr") * 1000, 0) / 1e8).alias("atr")), "instrument_id")
    s = s.join(per, "instrument_id", "left")
    return s.withColumns({"quote": F.col("q.close"), "price": F.col("q.close"), "move_bps": study.return_bps(F.col("a.close"), F.col("q.close")), "open_positions": F.col("k") % 12, "has_position": F.col("k") % 11 == 0}).drop("a", "q", "before")


WORLD = CALENDAR + """, tr AS (SELECT instrument_id, ts, row_number() OVER w - 1 AS i, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars_1d WINDOW w AS (PARTITION BY instrument_id ORDER BY ts)),
aw(instrument_id, i, atr) AS (SELECT instrument_id, 14::BIGINT, avg(tr) FROM tr WHERE i BETWEEN 1 AND 14 GROUP BY 1 HAVING count(*) = 14 UNION ALL SELECT a.instrument_id, tr.i, (a.atr * 13 + tr.tr) / 14 FROM aw a JOIN tr ON tr.instrument_id = a.instrument_id AND tr.i = a.i + 1),
av AS (SELECT instrument_id, CAST(round(last(atr ORDER BY i) * 1000) AS BIGINT) AS atr8 FROM aw GROUP BY 1),
mdv AS (SELECT instrument_id, CASE WHEN count(*) >= 10 THEN median(close * volume) END AS mdv FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY ts DESC) AS r FROM bars_1d) WHERE r <= 20 GROUP BY 1),
w1 AS (SELECT s.*, y.close AS p0 FROM sc s ASOF LEFT JOIN bars_1m y ON s.instrument_id = y.instrument_id AND y.ts <= s.anchor_ts - INTERVAL 1 MINUTE),
w2 AS (SELECT s.*, y.close AS quote, anchor_ts + INTERVAL 10 MINUTE AS decision_at FROM w1 s ASOF LEFT JOIN bars_1m y ON s.instrument_id = y.instrument_id AND y.ts <= s.anchor_ts + INTERVAL 10 MINUTE),
wf AS (SELECT w2.*, atr8, mdv, (quote - p0) / p0 * 10000 AS move_bps FROM w2 LEFT JOIN av USING (instrument_id) LEFT JOIN mdv USING (instrument_id)),
g AS (SELECT *, [CASE WHEN direction IN ('bullish', 'bearish') THEN '' ELSE 'direction_actionable' END, CASE WHEN confidence >= 0.5 THEN '' ELSE 'min_confidence' END, CASE WHEN NOT already_expected THEN '' ELSE 'already_expected' END,
  CASE WHEN NOT calendar_match THEN '' ELSE 'calendar_match' END, CASE WHEN event_type IN ('earnings', 'merger', 'product') THEN '' ELSE 'event_type_whitelist' END, CASE WHEN abs(move_bps) <= 12000 THEN '' ELSE 'stale_move' END,
  CASE WHEN asset_class = 'crypto' OR mdv >= 100000 THEN '' ELSE 'liquidity' END, CASE WHEN k % 12 < 10 THEN '' ELSE 'max_concurrent_positions' END, CASE WHEN k % 11 <> 0 THEN '' ELSE 'no_existing_position' END] AS gates FROM wf),
gg AS (SELECT *, list_filter(gates, lambda x: x <> '') AS failed FROM g),
z AS (SELECT *, CAST(round(quote * 100) AS HUGEINT) * 1000000 AS p8, (500::HUGEINT * 100000000 * 100000000) // (2 * atr8) AS q0 FROM gg),
z1 AS (SELECT *, CASE WHEN asset_class = 'crypto' THEN q0 ELSE q0 // 100000000 * 100000000 END AS q1 FROM z),
z2 AS (SELECT *, CASE WHEN q1 * p8 // 100000000 > 10000::HUGEINT * 100000000 THEN CASE WHEN asset_class = 'crypto' THEN 10000::HUGEINT * 10000000000000000 // p8 ELSE 10000::HUGEINT * 10000000000000000 // p8 // 100000000 * 100000000 END ELSE q1 END AS q2 FROM z1)
"""
WV = "signals scheduled bars_1m bars_1d"


@query(WV, WORLD + "SELECT signal_id, failed[1] AS skip_reason, CAST(len(failed) AS INT) AS n_failed FROM gg", True)
def decide_gates(spark, sf) -> DataFrame:
    return decide.screened(world(spark, sf), RULES).select("signal_id", "skip_reason", "n_failed")


@query(WV, WORLD + "SELECT coalesce(failed[1], '(none)') AS skip_reason, count(*) AS n FROM gg GROUP BY 1", True)
def skip_reasons(spark, sf) -> DataFrame:
    return decide.screened(world(spark, sf), RULES).groupBy(F.coalesce("skip_reason", F.lit("(none)")).alias("skip_reason")).agg(n())


@query(WV, WORLD + "SELECT signal_id, CASE WHEN q2 <= 0 THEN 'position_too_small' END AS size_reason, CASE WHEN q2 > 0 THEN CAST(q2 AS DOUBLE) / 1e8 END AS qty, CASE WHEN q2 > 0 THEN round(CAST(q2 * p8 // 100000000 AS DOUBLE) / 1e8, 6) END AS notional FROM z2 WHERE quote IS NOT NULL", True)
def sizing(spark, sf) -> DataFrame:
    s = decide.sized(world(spark, sf).filter("quote IS NOT NULL"), 100_000.0, RULES)
    return s.select("signal_id", "size_reason", F.col("qty").cast("double").alias("qty"), r6(F.col("notional").cast("double")).alias("notional"))


@query("fills", """, d AS (SELECT *, CAST(price AS DECIMAL(18, 6)) AS p, CAST(qty AS DECIMAL(18, 8)) AS q FROM fills),
f AS (SELECT *, round(p * CAST(CASE side WHEN 'buy' THEN 1.0005 ELSE 0.9995 END AS DECIMAL(6, 4)), 6) AS fp FROM d)
SELECT side, instrument_id, count(*) AS n, round(CAST(sum(fp) AS DOUBLE), 4) AS prices, round(CAST(sum(round(CAST(fp AS DECIMAL(38, 6)) * CAST(q AS DECIMAL(38, 2)) * CAST(CASE WHEN instrument_id % 2 = 0 THEN 0.0026 ELSE 0 END AS DECIMAL(4, 4)), 6)) AS DOUBLE), 4) AS fees FROM f GROUP BY 1, 2""")
def sim_fills(spark, sf) -> DataFrame:
    fee_bps = F.when(F.col("instrument_id") % 2 == 0, C.FEE_BPS["crypto"]).otherwise(C.FEE_BPS["us_equity"])
    price, _, fee = decide.filled(F.col("side"), F.col("price"), F.col("qty"), fee_bps)
    f = V.fills(spark, sf).select("side", "instrument_id", price.alias("fp"), fee.alias("f"))
    return f.groupBy("side", "instrument_id").agg(n(), F.round(F.sum("fp").cast("double"), 4).alias("prices"), F.round(F.sum("f").cast("double"), 4).alias("fees"))


def positions(spark, sf) -> DataFrame:
    """A position for every signal with a side and a quote, a day long."""
    w = world(spark, sf).filter("quote IS NOT NULL AND direction <> 'neutral'")
    return w.select(F.col("signal_id").alias("position_id"), "signal_id", "instrument_id", "event_type", "confidence", F.col("decision_at").alias("opened_at"), F.col("quote").alias("entry_price"), (F.col("direction") == "bullish").alias("is_long"), (F.col("quote") * 0.25).alias("atr"), F.lit(24.0).alias("hours"))


EXITS = """, po AS (SELECT signal_id, instrument_id, event_type, confidence, decision_at AS opened_at, quote AS entry, direction = 'bullish' AS long, quote * 0.25 AS a FROM wf WHERE quote IS NOT NULL AND direction <> 'neutral'),
ej AS (SELECT p.*, y.ts, y.close, CASE WHEN -(CASE WHEN long THEN y.close - entry ELSE entry - y.close END) >= a * 2 THEN 'stop_loss' WHEN (CASE WHEN long THEN y.close - entry ELSE entry - y.close END) >= a * 3 THEN 'take_profit'
   WHEN y.ts >= opened_at + INTERVAL 1 DAY THEN 'time_stop' END AS reason FROM po p JOIN bars_1m y ON p.instrument_id = y.instrument_id AND y.ts > opened_at AND y.ts <= opened_at + INTERVAL 1 DAY),
ex AS (SELECT signal_id, min(ts) AS exit_ts, first(close ORDER BY ts) AS exit_price, first(reason ORDER BY ts) AS exit_reason FROM ej WHERE reason IS NOT NULL GROUP BY 1),
td AS (SELECT po.*, exit_ts, exit_price, exit_reason, CASE WHEN long THEN 10 ELSE -10 END AS qty, round((exit_price - entry) * CASE WHEN long THEN 10 ELSE -10 END, 2) AS pnl FROM po JOIN ex USING (signal_id))
"""


@query(WV, WORLD + EXITS + "SELECT signal_id, exit_ts, exit_price, exit_reason FROM po LEFT JOIN ex USING (signal_id)", True)
def exit_instants(spark, sf) -> DataFrame:
    return decide.exit_instants(positions(spark, sf), V.bars_1m(spark, sf), RULES).select("signal_id", "exit_ts", "exit_price", "exit_reason")


def trades(spark, sf) -> DataFrame:
    x = decide.exit_instants(positions(spark, sf), V.bars_1m(spark, sf), RULES).filter("exit_ts IS NOT NULL")
    qty = F.when(F.col("is_long"), 10).otherwise(-10)
    return x.withColumns({"qty": qty, "opened_at": F.col("opened_at"), "closed_at": F.col("exit_ts"), "realized_usd": F.round((F.col("exit_price") - F.col("entry_price")) * qty, 2)})


@query(
    WV,
    WORLD + EXITS + """, eq AS (SELECT event_type, exit_ts, signal_id, 10000 + sum(pnl) OVER (PARTITION BY event_type ORDER BY exit_ts, signal_id ROWS UNBOUNDED PRECEDING) AS e FROM td),
pk AS (SELECT *, greatest(10000, max(e) OVER (PARTITION BY event_type ORDER BY exit_ts, signal_id ROWS UNBOUNDED PRECEDING)) AS p FROM eq), dd AS (SELECT event_type, max((p - e) / p) * 100 AS dd FROM pk GROUP BY 1)
SELECT event_type, count(*) AS trades, CAST(count_if(pnl > 0) AS BIGINT) AS wins, CAST(count_if(pnl < 0) AS BIGINT) AS losses, round(count_if(pnl > 0) / count(*), 6) AS hit_rate, round(avg(pnl / (abs(qty) * entry) * 10000), 4) AS avg_bps,
 round(sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) / sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0 END), 6) AS profit_factor, round(sum(pnl), 2) AS realized_usd,
 round(sum(pnl) / (sum(abs(qty) * entry * epoch_us(exit_ts - opened_at) / 1000) / (epoch_us(max(exit_ts) - min(opened_at)) / 1000)) * 100, 4) AS exposure_return_pct, round(any_value(dd), 6) AS max_drawdown_pct FROM td JOIN dd USING (event_type) GROUP BY 1""",
    True,
)
def run_metrics(spark, sf) -> DataFrame:
    m = stats.run_metrics(trades(spark, sf), 10_000.0, ["event_type"], ["closed_at", "signal_id"])
    return m.select("event_type", "trades", "wins", "losses", r6("hit_rate").alias("hit_rate"), F.round("avg_bps", 4).alias("avg_bps"), r6("profit_factor").alias("profit_factor"), F.round("realized_usd", 2).alias("realized_usd"), F.round("exposure_return_pct", 4).alias("exposure_return_pct"), r6("max_drawdown_pct").alias("max_drawdown_pct"))


@query(WV, WORLD + EXITS + "SELECT exit_reason, event_type, count(*) AS n, round(sum(pnl), 2) AS realized_usd, round(avg(confidence), 6) AS mean_confidence, round(count_if(pnl > 0) / count(*), 6) AS hit_rate FROM td GROUP BY 1, 2", True)
def round_trips(spark, sf) -> DataFrame:
    """Closed trades with what their signals were."""
    pnl = F.col("realized_usd")
    return trades(spark, sf).groupBy("exit_reason", "event_type").agg(n(), F.round(F.sum(pnl), 2).alias("realized_usd"), r6(F.avg("confidence")).alias("mean_confidence"), r6(F.count_if(pnl > 0) / F.count(F.lit(1))).alias("hit_rate"))


@query("fills", "SELECT instrument_id, round(sum(CASE side WHEN 'buy' THEN -1 ELSE 1 END * CAST(price AS DECIMAL(18, 6)) * CAST(qty AS DECIMAL(10, 2)) - CAST(fee AS DECIMAL(10, 2)))::DOUBLE, 2) AS cash_delta, round(sum(CAST(fee AS DECIMAL(10, 2)))::DOUBLE, 2) AS fees, sum(CASE side WHEN 'buy' THEN qty ELSE -qty END) AS qty FROM fills GROUP BY 1")
def portfolio_cash(spark, sf) -> DataFrame:
    sign = F.when(F.col("side") == "buy", -1).otherwise(1)
    f = V.fills(spark, sf).withColumn("amount", (F.col("price") * F.col("qty").cast("decimal(10,2)")).cast("decimal(28,8)"))
    return f.groupBy("instrument_id").agg(F.round(F.sum(sign * F.col("amount") - F.col("fee")).cast("double"), 2).alias("cash_delta"), F.round(F.sum("fee").cast("double"), 2).alias("fees"), F.sum(-sign * F.col("qty")).cast("double").alias("qty"))


# integers of hundredths of a share and of 10**-8 of a currency; halves are rounded away from zero
LOTS = """WITH RECURSIVE x AS (SELECT *, CAST(round(l_quantity * 100) AS HUGEINT) AS q, CAST(round(l_extendedprice * 100) AS HUGEINT) AS cents FROM lineitem),
o AS (SELECT l_partkey % 50 AS instrument_id, l_returnflag <> 'A' AS buy, q, (2 * cents * 1000000 + q) // (2 * q) AS p, CAST(round(l_tax * 100) AS HUGEINT) * 1000000 AS f,
  row_number() OVER (PARTITION BY l_partkey % 50 ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS i FROM x),
s(instrument_id, i, held, cost, realized, fees, cash) AS (
  SELECT instrument_id, 0::BIGINT, 0::HUGEINT, 0::HUGEINT, 0::HUGEINT, 0::HUGEINT, 0::HUGEINT FROM (SELECT DISTINCT instrument_id FROM o)
  UNION ALL
  SELECT instrument_id, i, CASE WHEN buy THEN held + q ELSE held - q END,
    CASE WHEN adds THEN cost + p * q WHEN q > abs(held) THEN p * (q - abs(held)) ELSE cost - gone END,
    CASE WHEN adds THEN realized WHEN held > 0 THEN realized + p * closing - gone ELSE realized + gone - p * closing END,
    fees + f, cash + CASE WHEN buy THEN -p * q ELSE p * q END - f
  FROM (SELECT *, CASE WHEN closing = abs(held) THEN cost ELSE (2 * cost * closing + abs(held)) // greatest(2 * abs(held), 1) END AS gone
    FROM (SELECT s.*, o.i AS j, o.buy, o.q, o.p, o.f, s.held = 0 OR (s.held > 0) = o.buy AS adds, least(o.q, abs(s.held)) AS closing FROM s JOIN o ON o.instrument_id = s.instrument_id AND o.i = s.i + 1)
    ) t(instrument_id, i0, held, cost, realized, fees, cash, i, buy, q, p, f, adds, closing, gone)),
e AS (SELECT instrument_id, last(held ORDER BY i) AS held, last(cost ORDER BY i) AS cost, last(realized ORDER BY i) AS realized, last(fees ORDER BY i) AS fees, last(cash ORDER BY i) AS cash FROM s GROUP BY 1)
SELECT instrument_id, CAST(held AS DOUBLE) / 100 AS qty, CASE WHEN held <> 0 THEN CAST((2 * cost + abs(held)) // (2 * abs(held)) AS DOUBLE) / 1000000 END AS avg_entry_price, CAST(cost AS DOUBLE) / 100000000 AS open_cost,
  CAST(realized AS DOUBLE) / 100000000 AS realized, CAST(fees AS DOUBLE) / 100000000 AS fees, CAST(cash AS DOUBLE) / 100000000 AS cash_delta FROM e"""


@query("", LOTS)
def lots(spark, sf) -> DataFrame:
    got = portfolio.lots(V.fills(spark, sf), ["filled_at", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return got.select("instrument_id", F.col("qty").cast("double").alias("qty"), F.col("avg_entry_price").cast("double").alias("avg_entry_price"), *[F.col(c).cast("double").alias(c) for c in ("open_cost", "realized", "fees", "cash_delta")])


def _world_for_book(spark, sf) -> DataFrame:
    w = decide.screened(world(spark, sf).withColumns({"open_positions": F.lit(0), "has_position": F.lit(False)}), RULES).withColumnRenamed("skip_reason", "world_reason")
    x = decide.exit_instants(positions(spark, sf), V.bars_1m(spark, sf), RULES).select(F.col("position_id").alias("_p"), "exit_ts", "exit_price", "exit_reason")
    w = w.join(x, F.col("signal_id") == F.col("_p"), "left").withColumn("run_id", F.col("prompt_version"))
    return portfolio.marked(w, V.bars_1m(spark, sf))


# the book in integers: cents of cash, 10**-8 of a share, 10**-6 of a price; products are of 10**-14 and sums stay positive, so halves go up
BOOK = """, wr AS (SELECT gg.*, list_filter(gates[1:7], lambda x: x <> '')[1] AS why, exit_ts, exit_price, exit_reason, CAST(round(quote * 100) AS HUGEINT) AS p2, CAST(round(exit_price * 100) AS HUGEINT) AS x2,
  CASE WHEN asset_class = 'crypto' THEN 26::HUGEINT ELSE 0::HUGEINT END AS bps, CASE WHEN direction = 'bearish' THEN -1::HUGEINT ELSE 1::HUGEINT END AS sign, row_number() OVER (PARTITION BY prompt_version ORDER BY decision_at, signal_id) AS n FROM gg LEFT JOIN ex USING (signal_id)),
mk AS (SELECT signal_id, list(struct_pack(i := d.instrument_id, p := CAST(round(y.close * 1000000) AS HUGEINT))) AS marks
  FROM (SELECT signal_id, decision_at, x.instrument_id FROM wr, (SELECT DISTINCT instrument_id FROM bars_1m) x) d ASOF JOIN bars_1m y ON d.instrument_id = y.instrument_id AND y.ts <= d.decision_at WHERE decision_at - y.ts <= INTERVAL 24 HOUR GROUP BY 1),
bo AS (SELECT wr.*, coalesce(marks, []) AS marks FROM wr LEFT JOIN mk USING (signal_id))
"""
WALK = """, {r}(run, n, cash, pos, signal_id, reason, q, equity) AS (
  SELECT DISTINCT prompt_version, 0::BIGINT, 10000000::HUGEINT, []::STRUCT(i BIGINT, q HUGEINT, e HUGEINT, x_ts TIMESTAMP, x2 HUGEINT, bps HUGEINT)[], NULL::BIGINT, NULL::VARCHAR, NULL::HUGEINT, NULL::HUGEINT FROM bo
  UNION ALL
  SELECT run, n, cash2, pos2, signal_id, reason, q,
    cash2 + (coalesce(list_sum(list_transform(pos2, lambda x: x.q * CASE WHEN quote IS NOT NULL AND x.i = instrument_id THEN p2 * 10000 ELSE coalesce(list_filter(marks, lambda y: y.i = x.i)[1].p, x.e) END))::HUGEINT, 0::HUGEINT) + 1000000000000500000000000) // 1000000000000 - 1000000000000
  FROM (SELECT *, CASE WHEN q IS NULL THEN cash1 ELSE cash1 + (-sign * q * entry - ((entry * q * bps + 500000000000) // 1000000000000) * 100000000 + 1000000000000500000000000) // 1000000000000 - 1000000000000 END AS cash2,
      CASE WHEN q IS NULL THEN lef ELSE list_append(lef, struct_pack(i := instrument_id, q := sign * q, e := entry, x_ts := exit_ts, x2 := x2, bps := bps)) END AS pos2
    FROM (SELECT *, p2 * (10000 + sign * 5) AS entry, CASE WHEN why2 IS NOT NULL THEN why2 WHEN atr8 IS NULL OR atr8 <= 0 THEN 'atr_available' WHEN q2 <= 0 THEN 'position_too_small' END AS reason, CASE WHEN why2 IS NULL AND atr8 > 0 AND q2 > 0 THEN q2 END AS q
      FROM (SELECT *, CASE WHEN q1 * p2 * 1000000 // 100000000 > eq * 100000 THEN CASE WHEN bps > 0 THEN eq * 100000 * 100000000 // (p2 * 1000000) ELSE eq * 100000 * 100000000 // (p2 * 1000000) // 100000000 * 100000000 END ELSE q1 END AS q2
        FROM (SELECT *, CASE WHEN bps > 0 THEN q0 ELSE q0 // 100000000 * 100000000 END AS q1
          FROM (SELECT *, CASE WHEN atr8 > 0 THEN eq * 1000000 * 50 // 10000 * 100000000 // (2 * atr8) END AS q0, CASE WHEN quote IS NULL THEN 'no_quote' ELSE coalesce(why, CASE WHEN len(lef) >= {most} THEN 'max_concurrent_positions' WHEN len(list_filter(lef, lambda x: x.i = instrument_id)) > 0 THEN 'no_existing_position' END) END AS why2
            FROM (SELECT *, cash1 + (coalesce(list_sum(list_transform(lef, lambda x: x.q * coalesce(list_filter(marks, lambda y: y.i = x.i)[1].p, x.e)))::HUGEINT, 0::HUGEINT) + 1000000000000500000000000) // 1000000000000 - 1000000000000 AS eq
              FROM (SELECT run, bo.n, bo.signal_id, instrument_id, quote, p2, x2, bps, sign, atr8, why, exit_ts, marks, list_filter(pos, lambda x: x.x_ts IS NULL OR x.x_ts > decision_at) AS lef,
                  cash + coalesce(list_sum(list_transform(list_filter(pos, lambda x: x.x_ts <= decision_at), lambda x: (x.q * x.x2 * (10000 - sign(x.q)::HUGEINT * 5) - ((x.x2 * (10000 - sign(x.q)::HUGEINT * 5) * abs(x.q) * x.bps + 500000000000) // 1000000000000) * 100000000 + 1000000000000500000000000) // 1000000000000 - 1000000000000))::HUGEINT, 0::HUGEINT) AS cash1
                FROM {r} w JOIN bo ON bo.prompt_version = w.run AND bo.n = w.n + 1))))))))
"""
OPENED = "CASE WHEN q IS NULL THEN 'skip' WHEN sign < 0 THEN 'open_short' ELSE 'open_long' END"


@query(WV, WORLD + EXITS + BOOK + WALK.format(r="bk", most=10) + f"SELECT run AS run_id, signal_id, {OPENED} AS action, reason AS skip_reason, CAST(q AS DOUBLE) / 100000000 AS qty, CAST(equity AS DOUBLE) / 100 AS equity FROM bk JOIN (SELECT signal_id, sign FROM wr) USING (signal_id)", True)
def backtest_decisions(spark, sf) -> DataFrame:
    return portfolio.backtest(_world_for_book(spark, sf), 100_000.0, RULES)[0]


@query(WV, WORLD + EXITS + BOOK + WALK.format(r="bk", most=10) + """, tr2 AS (SELECT run, bk.signal_id, instrument_id, sign * q AS q, p2 * (10000 + sign * 5) AS e, x2 * (10000 - sign * 5) AS x, bps, decision_at, exit_ts, exit_reason FROM bk JOIN wr USING (signal_id) WHERE q IS NOT NULL AND exit_ts IS NOT NULL)
SELECT run AS run_id, signal_id, instrument_id, CAST(q AS DOUBLE) / 100000000 AS qty, CAST(e AS DOUBLE) / 1000000 AS entry_price, CAST(x AS DOUBLE) / 1000000 AS exit_price, decision_at AS opened_at, exit_ts AS closed_at, exit_reason,
  CAST(CASE WHEN v < 0 THEN -((-v + 500000000000) // 1000000000000) ELSE (v + 500000000000) // 1000000000000 END AS DOUBLE) / 100 AS realized_usd FROM (SELECT *, q * (x - e) - ((x * abs(q) * bps + 500000000000) // 1000000000000) * 100000000 AS v FROM tr2)""", True)
def backtest_trades(spark, sf) -> DataFrame:
    t = portfolio.backtest(_world_for_book(spark, sf), 100_000.0, RULES)[1]
    return t.select("run_id", "signal_id", "instrument_id", *[F.col(c).cast("double").alias(c) for c in ("qty", "entry_price", "exit_price")], "opened_at", "closed_at", "exit_reason", F.col("realized_usd").cast("double").alias("realized_usd"))


@query(WV, WORLD + EXITS + BOOK + WALK.format(r="ba", most=10) + WALK.format(r="bb", most=1) + """SELECT CASE WHEN (a.q IS NULL) = (b.q IS NULL) AND a.reason IS NOT DISTINCT FROM b.reason THEN 'same' ELSE 'changed' END AS outcome, count(*) AS n FROM ba a JOIN bb b ON a.run = b.run AND a.signal_id = b.signal_id GROUP BY 1""", True)
def replay_comparison(spark, sf) -> DataFrame:
    """A run against its replay with a book of its own under stricter rules, key by key: the world's features are the same, the portfolio's are those of each book."""
    w = _world_for_book(spark, sf)
    a = portfolio.backtest(w, 100_000.0, RULES)[0]
    b = portfolio.backtest(w, 100_000.0, RULES | {"max_positions": 1})[0]
    return portfolio.compare(a, b, ["run_id", "signal_id"], ["action", "skip_reason"]).groupBy("outcome").agg(n())


@query("signals", "SELECT left(sha256('signal:' || signal_id || ':' || prompt_version), 32) AS client_order_id, 'signal:' || signal_id || ':' || prompt_version AS decision_key, instrument_id, CASE direction WHEN 'bullish' THEN 'buy' ELSE 'sell' END AS side, 'market' AS order_type, 'day' AS tif FROM signals WHERE direction <> 'neutral' AND anchor_ts >= TIMESTAMP '2024-01-20' - INTERVAL 6 HOUR AND signal_id % 3 <> 0")
def pending_intents(spark, sf) -> DataFrame:
    """Recent open decisions that have no order; every third signal has one already."""
    s = V.signals(spark, sf).filter("direction <> 'neutral'").withColumns({"decision_key": F.concat_ws(":", F.lit("signal"), F.col("signal_id").cast("string"), "prompt_version"), "decided_at": F.col("anchor_ts"), "action": F.when(F.col("direction") == "bullish", "open_long").otherwise("open_short"), "qty": F.lit(1)})
    orders = s.filter("signal_id % 3 = 0").select(decide.client_order_id(F.col("decision_key")).alias("client_order_id"))
    return decide.order_intents(s, orders, F.lit("2024-01-20").cast("timestamp_ntz")).drop("qty")
