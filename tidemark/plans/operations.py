"""Queues, contexts, calendars and the broker's state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.operators import broker, context, intervals, sinks
from tidemark.plans.sql import with_views
from tidemark.sources import views as V

QUERIES, ORACLES = {}, {}


def query(views: str, sql: str | None, recursive: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(views, sql, recursive) if views else sql
        return f

    return add


def n():
    return F.count(F.lit(1)).alias("n")


@query("", "SELECT doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR (quality = 0 AND toxic = 0) OR (n_chars > 5000 AND quality = 1)")
def document_queue(spark, sf) -> DataFrame:
    """What is to be fetched: absent, retryable or stale."""
    d = V.table(spark, sf, "documents").select("doc_id", "n_chars").join(V.table(spark, sf, "labels").withColumn("there", F.lit(True)), "doc_id", "left")
    retry = (F.col("quality") == 0) & (F.col("toxic") == 0)
    return d.filter(F.col("there").isNull() | retry | ((F.col("n_chars") > 5000) & (F.col("quality") == 1))).select("doc_id")


@query("", "SELECT k, day, min(event_id) AS event_id FROM (SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, date_trunc('day', ts)::TIMESTAMP AS day, event_id FROM events WHERE event_type = 'signup' AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20') f WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'view' AND CAST(json_extract_string(e.props, '$.k') AS INT) = f.k AND date_trunc('day', e.ts) = f.day) GROUP BY 1, 2")
def calendar_sync(spark, sf) -> DataFrame:
    """Fetched events inside the horizon, once each, that the calendar doesn't hold yet."""
    e = V.events(spark, sf).withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    lit = lambda d: F.lit(d).cast("timestamp_ntz")
    fetched = e.filter((F.col("event_type") == "signup") & (F.col("ts") >= lit("2024-01-10")) & (F.col("ts") < lit("2024-01-20"))).select("k", "day", "event_id")
    return sinks.absent(fetched, e.filter("event_type = 'view'").select("k", "day"), ["k", "day"], ["event_id"])


@query("anchors signals", "SELECT cluster_id, instrument_id, cluster_id || ':' || instrument_id || ':v1' AS signal_key FROM anchors a WHERE k >= 75 AND cluster_id % 5 <> 0 AND NOT (cluster_id % 7 = 0 AND k % 4 = 3)")
def interpretation_candidates(spark, sf) -> DataFrame:
    """Linked stories without a signal and with attempts to spare; every fifth has one, some have failed three times."""
    a = V.anchors(spark, sf)
    key = F.concat_ws(":", F.col("cluster_id").cast("string"), F.col("instrument_id").cast("string"), F.lit("v1"))
    done = a.filter("cluster_id % 5 = 0").select(key.alias("signal_key"))
    tried = a.filter("cluster_id % 7 = 0").select(key.alias("signal_key"), (F.col("k") % 4).alias("attempts"))
    return context.candidates(a.filter("k >= 75").select("cluster_id", "instrument_id"), done, tried, "v1", C.MODEL_ATTEMPTS)


@query("news_items", """, i AS (SELECT item_id // 5 AS cluster_id, item_id, received_at, min(received_at) OVER (PARTITION BY item_id // 5) AS first_at, headline, source FROM news_items),
t AS (SELECT *, row_number() OVER w AS r, left('[+' || CAST((epoch_us(received_at) - epoch_us(first_at)) // 60000000 AS VARCHAR) || 'm] ' || headline || CASE WHEN source <> '' THEN ' — ' || source ELSE '' END, 120) AS t FROM i WINDOW w AS (PARTITION BY cluster_id ORDER BY received_at, item_id)),
b AS (SELECT *, coalesce(sum(length(t) + 1) OVER (PARTITION BY cluster_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM t WHERE r <= 3),
c AS (SELECT cluster_id, r, left(t, CAST(greatest(300 - used, 0) AS INT)) AS t FROM b) SELECT cluster_id, count(*) AS n_items, string_agg(t, chr(10) ORDER BY r) AS context FROM c WHERE t <> '' GROUP BY 1""")
def prompt_contexts(spark, sf) -> DataFrame:
    i = V.news_items(spark, sf).withColumn("cluster_id", F.floor(F.col("item_id") / 5)).withColumn("body", F.col("source"))
    i = i.withColumn("first_at", F.min("received_at").over(W.partitionBy("cluster_id")))
    return context.contexts(i, 120, 300)


@query("signals", """, j AS (SELECT signal_id, CASE k % 3 WHEN 0 THEN 'none' ELSE 'sector' END AS scope, k, confidence, value * 10 AS move,
 CASE k % 5 WHEN 0 THEN [] WHEN 1 THEN ['Energy'] WHEN 2 THEN ['Energy', 'Energy'] WHEN 3 THEN ['moon'] ELSE ['Energy', 'Utilities'] END AS s, materiality AS m FROM signals),
r AS (SELECT *, CASE WHEN abs(move) > 2000 THEN 'move_range' WHEN scope = 'none' AND len(s) > 0 THEN 'scope_none_with_sectors' WHEN scope <> 'none' AND len(s) = 0 THEN 'scope_without_sectors' WHEN len(list_distinct(s)) < len(s) THEN 'duplicate_sector'
 WHEN list_contains(s, 'moon') THEN 'unknown_sector' WHEN len(s) > 0 AND m <= 0.1 THEN 'none_material' ELSE 'ok' END AS reason FROM j) SELECT reason, count(*) AS n FROM r GROUP BY 1""")
def coherence(spark, sf) -> DataFrame:
    s = V.signals(spark, sf)
    sector = lambda *names: F.array(*[F.struct(F.lit(x).alias("sector"), F.col("materiality").alias("materiality")) for x in names]) if names else F.array().cast("array<struct<sector:string,materiality:double>>")
    k = F.col("k") % 5
    sectors = F.when(k == 0, sector()).when(k == 1, sector("Energy")).when(k == 2, sector("Energy", "Energy")).when(k == 3, sector("moon")).otherwise(sector("Energy", "Utilities"))
    s = s.withColumns({"scope": F.when(F.col("k") % 3 == 0, "none").otherwise("sector"), "sectors": sectors})
    why = context.incoherent(F.col("scope"), F.col("sectors"), F.col("value") * 10, F.col("confidence"))
    return s.groupBy(F.coalesce(why, F.lit("ok")).alias("reason")).agg(n())


@query("fills bars_1m", """, f AS (SELECT instrument_id, side, qty::DECIMAL(12, 2) AS qty, price::DECIMAL(18, 6) AS price, fee::DECIMAL(18, 6) AS fee FROM fills),
p AS (SELECT instrument_id, sum(CASE side WHEN 'buy' THEN qty ELSE -qty END) AS qty, sum(CASE side WHEN 'buy' THEN -qty * price ELSE qty * price END - fee)::DOUBLE AS cash FROM f GROUP BY 1),
m AS (SELECT instrument_id, last(close ORDER BY ts) AS mark FROM bars_1m WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY 1), e AS (SELECT 1000000 + sum(cash) AS cash, coalesce(sum(qty * mark), 0) AS value FROM p LEFT JOIN m USING (instrument_id))
SELECT round(cash, 2) AS cash_usd, round(value, 2) AS market_value_usd, round(cash + value, 2) AS equity_usd FROM e""")
def account_state(spark, sf) -> DataFrame:
    a = broker.account(V.fills(spark, sf).withColumn("qty", F.col("qty").cast("decimal(12,2)")), V.bars_1m(spark, sf), F.lit("2024-01-20").cast("timestamp_ntz"), 1_000_000.0)
    return a.select(*[F.round(c, 2).alias(c) for c in a.columns])


@query("signals bars_1m", """, p AS (SELECT s.*, y.close AS entry FROM signals s ASOF JOIN bars_1m y ON s.instrument_id = y.instrument_id AND y.ts <= s.anchor_ts WHERE s.anchor_ts < TIMESTAMP '2024-01-20' AND s.anchor_ts >= TIMESTAMP '2024-01-18' AND direction <> 'neutral'),
q AS (SELECT p.*, y.close AS q FROM (SELECT *, TIMESTAMP '2024-01-20' AS now FROM p) p ASOF LEFT JOIN bars_1m y ON p.instrument_id = y.instrument_id AND y.ts <= p.now),
r AS (SELECT *, CASE WHEN -(CASE direction WHEN 'bullish' THEN q - entry ELSE entry - q END) >= entry * 0.5 THEN 'stop_loss' WHEN now >= anchor_ts + INTERVAL 24 HOUR THEN 'time_stop' END AS reason FROM q)
SELECT signal_id AS position_id, CASE WHEN reason IS NULL THEN 'held' WHEN k % 5 >= 3 THEN 'suppressed' ELSE 'closed' END AS outcome, reason FROM r""")
def position_manager(spark, sf) -> DataFrame:
    """Positions opened in the two days before, looked at once."""
    from tidemark.operators.asof import asof

    lit = lambda d: F.lit(d).cast("timestamp_ntz")
    bars = V.bars_1m(spark, sf)
    s = V.signals(spark, sf).filter((F.col("anchor_ts") < lit("2024-01-20")) & (F.col("anchor_ts") >= lit("2024-01-18")) & (F.col("direction") != "neutral"))
    p = asof(s, bars, ["instrument_id"], "anchor_ts", name="b").filter("b IS NOT NULL")
    p = p.select(F.col("signal_id").alias("position_id"), "instrument_id", F.col("anchor_ts").alias("opened_at"), F.col("b.close").alias("entry_price"), (F.col("direction") == "bullish").alias("is_long"), (F.col("b.close") * 0.25).alias("atr"), F.lit(24.0).alias("hours"), (F.col("k") % 5).alias("attempts"))
    return broker.manage(p.drop("attempts"), bars, p.select("position_id", "attempts"), lit("2024-01-20"))


@query("bars_1m bars_1d", """, l AS (SELECT instrument_id, max(ts) AS last_ts FROM bars_1m GROUP BY 1), d AS (SELECT instrument_id, ts + to_days(8400) + INTERVAL 24 HOUR AS ts, close FROM bars_1d)
SELECT instrument_id, count(*) AS n, max(ts) AS last_ts, round(sum(close), 2) AS total FROM (SELECT instrument_id, ts, close FROM bars_1m UNION ALL SELECT d.instrument_id, d.ts, d.close FROM d JOIN l USING (instrument_id) WHERE d.ts > last_ts) GROUP BY 1""")
def extended_series(spark, sf) -> DataFrame:
    """Minute bars, and after the last one daily closes at the end of their day; days are moved to follow the minutes."""
    daily = V.bars_1d(spark, sf).withColumn("ts", F.col("ts") + F.make_dt_interval(F.lit(8400)))
    return intervals.extended(V.bars_1m(spark, sf), daily).groupBy("instrument_id").agg(n(), F.max("ts").alias("last_ts"), F.round(F.sum("close"), 2).alias("total"))


@query("signals", "SELECT date_trunc('week', anchor_ts)::TIMESTAMP AS week, count(*) AS signals, count(*) FILTER (WHERE direction <> 'neutral') AS directional, count(*) FILTER (WHERE direction <> 'neutral' AND confidence >= 0.75) AS confident, count(*) FILTER (WHERE direction = 'bullish' AND confidence >= 0.75 AND NOT already_expected) AS tradable FROM signals s GROUP BY date_trunc('week', s.anchor_ts)")
def weekly_funnel(spark, sf) -> DataFrame:
    s = V.signals(spark, sf).groupBy(F.date_trunc("week", "anchor_ts").cast("timestamp_ntz").alias("week"))
    side, sure = F.col("direction") != "neutral", F.col("confidence") >= 0.75
    return s.agg(F.count(F.lit(1)).alias("signals"), F.count_if(side).alias("directional"), F.count_if(side & sure).alias("confident"), F.count_if((F.col("direction") == "bullish") & sure & ~F.col("already_expected")).alias("tradable"))
