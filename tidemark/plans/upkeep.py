"""Upkeep queries: universes, calendars, audit keys, contexts as of a time, snapshots decided again, reports of what is measured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import context, decide, entity, intervals, sinks, study
from tidemark.plans.decisions import RULES, WORLD, WV, world
from tidemark.plans.sql import with_views
from tidemark.plans.study import ABNORMAL, BETA, LADDER
from tidemark.plans.study import _abnormal as abnormal
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


def r6(c):
    return F.round(c, 6)


def lit(day: str):
    return F.lit(day).cast("timestamp_ntz")


def text(c):
    return F.col(c).cast("string")


@query("membership", """, i AS (SELECT s_suppkey AS instrument_id, 'S' || s_suppkey AS symbol, CASE WHEN s_suppkey % 10 = 0 THEN 'crypto' ELSE 'us_equity' END AS asset_class FROM supplier)
SELECT * FROM i WHERE asset_class = 'crypto' OR symbol = 'S1' OR EXISTS (SELECT 1 FROM membership m WHERE m.member_id = i.instrument_id AND valid_from <= TIMESTAMP '1996-06-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1996-06-01'))""")
def bar_universe(spark, sf) -> DataFrame:
    """Suppliers as instruments: members of a day, crypto, and the benchmark, once each."""
    i = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("instrument_id"), F.concat(F.lit("S"), text("s_suppkey")).alias("symbol"), F.when(F.col("s_suppkey") % 10 == 0, "crypto").otherwise("us_equity").alias("asset_class"))
    return intervals.bar_universe(i, V.membership(spark, sf).withColumnRenamed("member_id", "instrument_id"), lit("1996-06-01"), "S1")


@query("", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'B.' || c_custkey ELSE 'A' || c_custkey END AS symbol, CASE WHEN c_custkey % 3 <> 0 THEN lpad(CAST(c_custkey + 5 AS VARCHAR), 10, '0') ELSE lpad(CAST(c_custkey AS VARCHAR), 10, '0') END AS cik FROM customer")
def issuer_numbers(spark, sf) -> DataFrame:
    """Customers as constituents: the registrants' own map goes before the page's number, found with dashes for dots; a third isn't in it."""
    c = V.table(spark, sf, "customer")
    symbol = lambda dot: F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("B" + dot), text("c_custkey"))).otherwise(F.concat(F.lit("A"), text("c_custkey")))
    number = lambda add: F.lpad((F.col("c_custkey") + add).cast("string"), 10, "0").alias("cik")
    listed = c.select("c_custkey", symbol(".").alias("symbol"), number(0))
    official = c.filter("c_custkey % 3 <> 0").select(symbol("-").alias("symbol"), number(5))
    known = c.filter("c_custkey % 3 <> 0 AND c_custkey % 2 = 0").select(symbol(".").alias("symbol"), number(5))
    return entity.identified(listed, official, known)


CALENDAR_FETCHED = """, f AS (SELECT event_type || ':' || CAST(k AS VARCHAR) || ':' || CAST(ts::DATE AS VARCHAR) AS event_key, event_type AS kind, CASE WHEN k % 3 <> 0 THEN 'I-' || user_id % 12 END AS symbol, user_id % 12 AS i, ts AS scheduled_at FROM ev),
w AS (SELECT *, CASE WHEN symbol IS NOT NULL AND i >= 8 THEN 'not_members' WHEN scheduled_at < TIMESTAMP '2024-01-05' OR scheduled_at > TIMESTAMP '2024-01-12' + INTERVAL 10 DAY THEN 'outside' END AS why FROM f),
o AS (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY scheduled_at, symbol NULLS FIRST) AS r FROM w WHERE why IS NULL)
"""


def _fetched(spark, sf):
    e = V.events(spark, sf)
    day = F.date_format("ts", "yyyy-MM-dd")
    fetched = e.select(F.concat_ws(":", "event_type", text("k"), day).alias("event_key"), F.col("event_type").alias("kind"), F.when(F.col("k") % 3 != 0, F.concat(F.lit("i-"), (F.col("user_id") % 12).cast("string"))).alias("symbol"), F.col("ts").alias("scheduled_at"))
    symbols = spark.range(8).select(F.concat(F.lit("I."), text("id")).alias("symbol"), F.col("id").alias("instrument_id"))
    return intervals.calendar(fetched, symbols, lit("2024-01-12"), 10, lit("2024-01-05"))


@query("ev", CALENDAR_FETCHED + "SELECT event_key, kind, CASE WHEN symbol IS NOT NULL THEN i END AS instrument_id, scheduled_at, scheduled_at < TIMESTAMP '2024-01-11' AS backfilled FROM o WHERE r = 1")
def calendar_rows(spark, sf) -> DataFrame:
    """Events as fetched calendar entries with a backfill of a week."""
    return _fetched(spark, sf)[0]


@query("ev", CALENDAR_FETCHED + "SELECT CAST(count_if(why = 'outside') AS BIGINT) AS outside, (SELECT CAST(count_if(r > 1) AS BIGINT) FROM o) AS duplicates, CAST(count_if(why = 'not_members') AS BIGINT) AS not_members FROM w")
def calendar_counts(spark, sf) -> DataFrame:
    return _fetched(spark, sf)[1]


@query("bars_1d", ", h AS (SELECT * FROM bars_1d WHERE ts < TIMESTAMP '1998-06-01') SELECT instrument_id, ts, close, false AS is_new FROM h UNION ALL SELECT instrument_id, ts, close + 1, true FROM bars_1d WHERE ts >= TIMESTAMP '1998-06-01' AND ts <= TIMESTAMP '1998-06-20'")
def daily_upkeep(spark, sf) -> DataFrame:
    """Daily bars fetched over a lookback of thirty days: days that are there already keep their first values."""
    bars = V.bars_1d(spark, sf).select("instrument_id", "ts", "close")
    held = bars.filter(F.col("ts") < lit("1998-06-01"))
    fetched = bars.filter((F.col("ts") >= lit("1998-06-20") - study.days(30)) & (F.col("ts") <= lit("1998-06-20"))).withColumn("close", F.col("close") + 1)
    new = sinks.absent(fetched, held, ["instrument_id", "ts"])
    return held.withColumn("is_new", F.lit(False)).unionByName(new.withColumn("is_new", F.lit(True)))


@query("signals", "SELECT 'llm/' || strftime(max(anchor_ts), '%Y-%m-%d') || '/' || left(sha256(instrument_id || ':' || prompt_version), 16) || '.json' AS key, max(anchor_ts) AS analyzed_at, arg_max(signal_id, anchor_ts) AS signal_id FROM signals GROUP BY instrument_id, prompt_version, anchor_ts::DATE")
def audit_rows(spark, sf) -> DataFrame:
    """Signals as attempts on (instrument, version): the last one of a day stays."""
    a = V.signals(spark, sf).select(F.concat_ws(":", text("instrument_id"), "prompt_version").alias("signal_key"), F.col("anchor_ts").alias("analyzed_at"), "signal_id")
    return sinks.write_audit(a, a.limit(0).withColumn("key", F.lit(""))).select("key", "analyzed_at", "signal_id")


STORIES = """, i AS (SELECT *, item_id // 20 AS cluster_id, min(received_at) OVER (PARTITION BY item_id // 20) AS first_at FROM news_items)
"""


def _stories(spark, sf):
    from pyspark.sql import Window as W

    i = V.news_items(spark, sf).withColumn("cluster_id", F.floor(F.col("item_id") / 20))
    return i.withColumn("first_at", F.min("received_at").over(W.partitionBy("cluster_id")))


@query("news_items", STORIES + "SELECT cluster_id, count(*) AS n_items, count(DISTINCT source) AS n_sources FROM i WHERE received_at - first_at <= INTERVAL 7 MINUTE GROUP BY 1")
def story_counts_as_of(spark, sf) -> DataFrame:
    """Stories of twenty items a minute apart, as large as they were after seven minutes."""
    return context.counts_as_of(_stories(spark, sf), 7)


@query("news_items", STORIES + "SELECT cluster_id, item_id FROM i WHERE received_at <= least(first_at + INTERVAL 5 MINUTE, TIMESTAMP '2024-01-01 01:00:00')")
def context_items(spark, sf) -> DataFrame:
    """What a scorer may see of each story at one in the morning."""
    return context.as_of(_stories(spark, sf), lit("2024-01-01 01:00:00")).select("cluster_id", "item_id")


@query("signals", """, j AS (SELECT *, CASE k % 6 WHEN 0 THEN 'earnings_result' WHEN 1 THEN 'other' WHEN 2 THEN 'earnings' ELSE 'merger_acquisition' END AS kind, CASE k % 7 WHEN 0 THEN '2d' ELSE '3d' END AS h, value * 30 AS move, k / 80 AS conf, repeat('x', k * 8) AS why FROM signals)
SELECT CASE WHEN kind = 'earnings' THEN 'event_type' WHEN h = '2d' THEN 'horizon' WHEN move > 5000 THEN 'move_range' WHEN conf > 1 THEN 'confidence_range' WHEN length(why) NOT BETWEEN 1 AND 600 THEN 'reasoning' ELSE 'ok' END AS reason, count(*) AS n FROM j GROUP BY 1""")
def judgment_checks(spark, sf) -> DataFrame:
    """Judgments of companies against the closed vocabularies and ranges."""
    k = F.col("k")
    kind = F.when(k % 6 == 0, "earnings_result").when(k % 6 == 1, "other").when(k % 6 == 2, "earnings").otherwise("merger_acquisition")
    why = context.refused(kind, F.col("direction"), F.when(k % 7 == 0, "2d").otherwise("3d"), F.col("value") * 30, F.col("materiality"), k / 80, F.repeat(F.lit("x"), (k * 8).cast("int")))
    return V.signals(spark, sf).groupBy(F.coalesce(why, F.lit("ok")).alias("reason")).agg(n())


@query("signals", """, j AS (SELECT signal_id, k, CASE k % 4 WHEN 0 THEN [] WHEN 1 THEN ['s' || k % 13] ELSE ['S' || k % 13, 's' || (k + 9) % 31] END AS c FROM signals WHERE k % 5 <> 0),
e AS (SELECT signal_id, unnest(c) AS x FROM j), u AS (SELECT signal_id, x, CAST(substr(x, 2) AS BIGINT) AS id FROM e)
SELECT j.signal_id AS judgment_id, coalesce(CAST(count_if(id < 20) AS BIGINT), 0) AS n_known, coalesce(CAST(count_if(id >= 20) AS BIGINT), 0) AS n_unknown, coalesce(sum(id) FILTER (WHERE id < 20), 0)::BIGINT AS instruments FROM j LEFT JOIN u USING (signal_id) GROUP BY 1""")
def discovered_companies(spark, sf) -> DataFrame:
    """Companies that judgments name, against a universe of twenty."""
    k = F.col("k")
    one = lambda mark, i: F.struct(F.concat(F.lit(mark), i.cast("string")).alias("symbol"), F.lit("bullish").alias("direction"), F.lit(0.5).alias("materiality"), F.lit(10.0).alias("move_bps"))
    companies = F.when(k % 4 == 0, F.array().cast("array<struct<symbol:string,direction:string,materiality:double,move_bps:double>>")).when(k % 4 == 1, F.array(one("s", k % 13))).otherwise(F.array(one("S", k % 13), one("s", (k + 9) % 31)))
    judged = V.signals(spark, sf).select(F.col("signal_id").alias("judgment_id"), F.when(k % 5 == 0, "none").otherwise("company").alias("scope"), companies.alias("companies"))
    universe = spark.range(20).select(F.concat(F.lit("S"), text("id")).alias("symbol"), F.col("id").alias("instrument_id"))
    rows, counts = entity.discovered(judged, universe)
    total = rows.groupBy("judgment_id").agg(F.sum("instrument_id").alias("instruments"))
    return counts.join(total, "judgment_id", "left").fillna(0, ["instruments"])


@query(WV, WORLD + """, alt AS (SELECT signal_id, failed[1] AS was, [CASE WHEN confidence >= 0.7 THEN '' ELSE 'min_confidence' END] AS c, gates FROM gg),
re AS (SELECT signal_id, was, list_filter(gates[1:1] || c || gates[3:], lambda x: x <> '')[1] AS now FROM alt)
SELECT CASE WHEN was IS NOT DISTINCT FROM now THEN 'same' WHEN now IS NULL THEN 'opened' WHEN was IS NULL THEN 'closed' ELSE 'other_reason' END AS outcome, coalesce(now, '(none)') AS reason, count(*) AS n FROM re GROUP BY 1, 2""", True)
def replay_snapshots(spark, sf) -> DataFrame:
    """Decisions with their features stored as JSON, and decided again from these under a higher confidence."""
    stored = decide.screened(world(spark, sf), RULES).drop("gates", "n_failed")
    kept = stored.select("signal_id", "skip_reason", F.to_json(F.struct(*[c for c in stored.columns if c not in ("signal_id", "skip_reason")])).alias("snapshot"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema if f.name not in ("signal_id", "skip_reason"))
    again = decide.replayed(kept.select("signal_id", "skip_reason", F.from_json("snapshot", fields).alias("s")).select("signal_id", "skip_reason", "s.*"), RULES | {"min_confidence": 0.7})
    return again.groupBy("outcome", F.coalesce("replay_reason", F.lit("(none)")).alias("reason")).agg(n())


@query("signals", "SELECT signal_id, CAST(k % 6 AS INT) AS open_positions, k % 2 = 0 AS has_position, confidence FROM signals WHERE signal_id % 3 <> 0 UNION ALL SELECT signal_id, CAST(k % 12 AS INT), k % 11 = 0, confidence FROM signals WHERE signal_id % 3 = 0")
def feature_overlay(spark, sf) -> DataFrame:
    """A portfolio recomputed for two thirds of the snapshots."""
    s = V.signals(spark, sf)
    k = F.col("k")
    base = s.select("signal_id", (k % 12).cast("int").alias("open_positions"), (k % 11 == 0).alias("has_position"), "confidence")
    new = s.filter("signal_id % 3 <> 0").select("signal_id", (k % 6).cast("int").alias("open_positions"), (k % 2 == 0).alias("has_position"))
    return decide.overlaid(base, new, "signal_id")


CHAIN = LADDER + BETA + ABNORMAL
RANKS = "CASE horizon WHEN '5m' THEN 1 WHEN '15m' THEN 2 WHEN '30m' THEN 3 WHEN '1h' THEN 4 WHEN '4h' THEN 5 WHEN '1d' THEN 6 WHEN '3d' THEN 7 ELSE 8 END"


@query("anchors bars_session bars_1d", CHAIN + f"SELECT {RANKS} AS place, horizon, count(*) AS n, round(median(abnormal_bps), 6) AS median_bps, round(median(abs(abnormal_bps)), 6) AS median_size_bps, round(avg(abnormal_bps), 6) AS mean_bps FROM abn GROUP BY 2")
def reaction_overview(spark, sf) -> DataFrame:
    """Reactions by horizon, in the order of horizons."""
    a = abnormal(spark, sf).groupBy("horizon").agg(n(), r6(F.median("abnormal_bps")).alias("median_bps"), r6(F.median(F.abs("abnormal_bps"))).alias("median_size_bps"), r6(F.avg("abnormal_bps")).alias("mean_bps"))
    return a.withColumn("place", study.horizon_order(F.col("horizon")).cast("int")).orderBy("place")


@query("anchors bars_session", LADDER + "SELECT cluster_id, instrument_id, anchor_ts FROM anchors WHERE anchor_ts >= TIMESTAMP '2024-01-14' AND NOT EXISTS (SELECT 1 FROM lad WHERE lad.cluster_id = anchors.cluster_id AND lad.instrument_id = anchors.instrument_id)")
def unmeasured_pairs(spark, sf) -> DataFrame:
    """Stories of the second half of the month without any reaction."""
    a = V.anchors(spark, sf)
    done = study.ladder(a, V.bars_session(spark, sf)).select("cluster_id", "instrument_id").distinct()
    return a.filter(F.col("anchor_ts") >= lit("2024-01-14")).join(done, ["cluster_id", "instrument_id"], "left_anti").select("cluster_id", "instrument_id", "anchor_ts")


@query("scheduled", "SELECT CASE WHEN instrument_id IS NULL THEN 'macro' ELSE 'earnings' END AS kind, count(*) AS events, min(scheduled_at) AS next_at FROM scheduled WHERE scheduled_at >= TIMESTAMP '2024-01-10' AND scheduled_at <= TIMESTAMP '2024-01-17' GROUP BY 1")
def calendar_ahead(spark, sf) -> DataFrame:
    """What the calendar holds for a week, by kind."""
    s = V.scheduled_events(spark, sf).filter(F.col("scheduled_at").between(lit("2024-01-10"), lit("2024-01-17")))
    return s.groupBy(F.when(F.col("instrument_id").isNull(), "macro").otherwise("earnings").alias("kind")).agg(F.count(F.lit(1)).alias("events"), F.min("scheduled_at").alias("next_at"))


@query("anchors", """, l AS (SELECT instrument_id, published_ts, anchor_ts, (epoch_us(anchor_ts) - epoch_us(published_ts)) / 1000000 AS s, published_ts >= anchor_ts - INTERVAL 24 HOUR AND published_ts <= anchor_ts + INTERVAL 2 MINUTE AS ok FROM anchors)
SELECT instrument_id, count(*) AS items, count(published_ts) AS with_published, CAST(count_if(published_ts > anchor_ts + INTERVAL 2 MINUTE) AS BIGINT) AS implausible, round(quantile_cont(s, 0.5) FILTER (WHERE ok)) AS median_latency_s, round(quantile_cont(s, 0.9) FILTER (WHERE ok)) AS p90_latency_s FROM l GROUP BY 1""")
def ingest_latency(spark, sf) -> DataFrame:
    """Receipt less publication, where the claim is credible."""
    a, p = F.col("anchor_ts"), F.col("published_ts")
    s = (F.unix_micros(a.cast("timestamp")) - F.unix_micros(p.cast("timestamp"))) / 1_000_000
    ok = (p >= a - study.days(1)) & (p <= a + study.minutes(2))
    at = lambda q: F.round(F.percentile(F.when(ok, s), q))
    return V.anchors(spark, sf).groupBy("instrument_id").agg(F.count(F.lit(1)).alias("items"), F.count("published_ts").alias("with_published"), F.count_if(p > a + study.minutes(2)).alias("implausible"), at(0.5).alias("median_latency_s"), at(0.9).alias("p90_latency_s"))
