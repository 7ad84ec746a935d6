"""Event-study queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.operators import study
from tidemark.operators.asof import asof, fresh, with_next
from tidemark.plans.sql import with_views
from tidemark.sources import views as V

QUERIES, ORACLES = {}, {}
LADDER = """, b AS (SELECT *, lead(ts) OVER w AS next_ts, lead(close) OVER w AS next_close FROM bars_session WINDOW w AS (PARTITION BY instrument_id ORDER BY ts)),
a0 AS (SELECT x.*, y.ts AS a_ts, y.close AS a_close, y.next_ts AS a_next FROM anchors x ASOF JOIN b y ON x.instrument_id = y.instrument_id AND y.ts <= x.anchor_ts - INTERVAL 1 MINUTE),
a AS (SELECT * FROM a0 WHERE a_ts >= anchor_ts - INTERVAL 72 HOUR AND (anchor_ts - INTERVAL 1 MINUTE - a_ts <= INTERVAL 30 MINUTE OR a_next <= anchor_ts + INTERVAL 8 DAY)),
hs(horizon, m, falls) AS (VALUES ('5m', 5, false), ('15m', 15, false), ('30m', 30, false), ('1h', 60, false), ('4h', 240, false), ('1d', 1440, true), ('3d', 4320, true), ('5d', 7200, true)),
p AS (SELECT a.*, horizon, falls, anchor_ts + to_minutes(m) AS h_ts FROM a, hs),
q AS (SELECT p.*, y.ts AS b_ts, y.close AS b_close, y.next_ts AS b_next, y.next_close AS b_next_close FROM p ASOF JOIN b y ON p.instrument_id = y.instrument_id AND y.ts <= p.h_ts),
l AS (SELECT cluster_id, instrument_id, anchor_ts, published_ts, k, a_ts, a_close, horizon, b_ts <= a_ts AS fell,
        CASE WHEN b_ts > a_ts THEN b_ts WHEN falls AND b_next <= h_ts + INTERVAL 3 DAY AND b_next <= anchor_ts + INTERVAL 8 DAY THEN b_next END AS used_ts,
        CASE WHEN b_ts > a_ts THEN b_close ELSE b_next_close END AS used_close
      FROM q WHERE h_ts - b_ts <= INTERVAL 30 MINUTE OR b_next <= anchor_ts + INTERVAL 8 DAY),
lad AS (SELECT *, (used_close - a_close) / a_close * 10000 AS raw_bps FROM l WHERE used_ts IS NOT NULL)
"""
BETA = """, bt AS (SELECT d.instrument_id, d.ts, ln(d.close / lag(d.close) OVER w) AS r, ln(m.close / lag(m.close) OVER w) AS rb
  FROM bars_1d d JOIN bars_1d m ON d.ts = m.ts AND m.instrument_id = 0 WHERE d.instrument_id <> 0 WINDOW w AS (PARTITION BY d.instrument_id ORDER BY d.ts)),
beta AS (SELECT instrument_id, count(*) AS n_days, CASE WHEN count(*) >= 30 THEN regr_slope(r, rb) END AS beta FROM bt GROUP BY 1)
"""
MARKET = ", mk AS (SELECT ts, close, lead(ts) OVER (ORDER BY ts) AS next_ts FROM bars_session WHERE instrument_id = 0)\n"
ABNORMAL = MARKET + """, x1 AS (SELECT lad.*, beta, y.ts AS ba_ts, y.close AS ba_close, y.next_ts AS ba_next FROM lad LEFT JOIN beta USING (instrument_id) ASOF LEFT JOIN mk y ON y.ts <= lad.anchor_ts - INTERVAL 1 MINUTE),
x2 AS (SELECT x1.*, y.ts AS bb_ts, y.close AS bb_close, y.next_ts AS bb_next FROM x1 ASOF LEFT JOIN mk y ON y.ts <= x1.used_ts),
ab AS (SELECT *, coalesce(beta IS NOT NULL AND ba_ts >= anchor_ts - INTERVAL 72 HOUR
    AND (anchor_ts - INTERVAL 1 MINUTE - ba_ts <= INTERVAL 30 MINUTE OR coalesce(ba_next <= anchor_ts + INTERVAL 8 DAY, false))
    AND (used_ts - bb_ts <= INTERVAL 30 MINUTE OR coalesce(bb_next <= anchor_ts + INTERVAL 8 DAY, false)) AND bb_ts > ba_ts, false) AS ok FROM x2),
abn AS (SELECT *, CASE WHEN ok THEN raw_bps - beta * (bb_close - ba_close) / ba_close * 10000 ELSE raw_bps END AS abnormal_bps, CASE WHEN ok THEN beta END AS beta_used FROM ab)
"""


def query(views: str, sql: str | None, recursive: bool = False):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(views, sql, recursive) if views else sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


@query("anchors bars_session", LADDER + "SELECT cluster_id, instrument_id, horizon, used_ts, fell AS fell_forward, round(raw_bps, 6) AS raw_bps FROM lad")
def reaction_ladder(spark, sf) -> DataFrame:
    rows = study.ladder(V.anchors(spark, sf), V.bars_session(spark, sf))
    return rows.select("cluster_id", "instrument_id", "horizon", "used_ts", "fell_forward", r6("raw_bps").alias("raw_bps"))


def _abnormal(spark, sf) -> DataFrame:
    bars = V.bars_session(spark, sf)
    return study.abnormal(study.ladder(V.anchors(spark, sf), bars), bars, study.beta(V.bars_1d(spark, sf), V.BENCHMARK), V.BENCHMARK)


@query("anchors bars_session bars_1d", LADDER + BETA + ABNORMAL + "SELECT cluster_id, instrument_id, horizon, round(raw_bps, 6) AS raw_bps, round(abnormal_bps, 6) AS abnormal_bps, round(beta_used, 6) AS beta_used FROM abn")
def reaction_abnormal(spark, sf) -> DataFrame:
    return _abnormal(spark, sf).select("cluster_id", "instrument_id", "horizon", r6("raw_bps").alias("raw_bps"), r6("abnormal_bps").alias("abnormal_bps"), r6("beta_used").alias("beta_used"))


@query("bars_1d", BETA + "SELECT instrument_id, n_days, round(beta, 6) AS beta FROM beta")
def beta_by_instrument(spark, sf) -> DataFrame:
    return study.beta(V.bars_1d(spark, sf), V.BENCHMARK).select("instrument_id", "n_days", r6("beta").alias("beta"))


@query(
    "anchors bars_session bars_1d",
    LADDER + BETA + ABNORMAL + """SELECT cluster_id, instrument_id, """ + ", ".join(f"round(max(abnormal_bps) FILTER (WHERE horizon = '{h}'), 6) AS abn_{h}" for h in C.HORIZONS) + " FROM abn GROUP BY 1, 2",
)
def ladder_pivot(spark, sf) -> DataFrame:
    wide = _abnormal(spark, sf).groupBy("cluster_id", "instrument_id").pivot("horizon", list(C.HORIZONS)).agg(F.max("abnormal_bps"))
    return wide.select("cluster_id", "instrument_id", *[r6(h).alias(f"abn_{h}") for h in C.HORIZONS])


def _series(spark, sf, anchors, bars, until_days, **more) -> DataFrame:
    return study.series(anchors, bars, until_days, betas=study.beta(V.bars_1d(spark, sf), V.BENCHMARK), benchmark=V.BENCHMARK, **more)


# anchors with the benchmark's settled bar, and bars with the benchmark's last one
SIDES = """, sa AS (SELECT a.*, beta, y.ts AS m_ts, y.close AS m_close, y.next_ts AS m_next FROM a LEFT JOIN beta USING (instrument_id) ASOF LEFT JOIN mk y ON y.ts <= a.anchor_ts - INTERVAL 1 MINUTE),
sb AS (SELECT *, CASE WHEN beta IS NOT NULL AND m_ts >= anchor_ts - INTERVAL 72 HOUR
    AND (anchor_ts - INTERVAL 1 MINUTE - m_ts <= INTERVAL 30 MINUTE OR coalesce(m_next <= anchor_ts + INTERVAL 8 DAY, false)) THEN m_ts END AS ba_ts FROM sa),
su AS (SELECT sb.*, y.ts AS u_ts, y.next_ts AS u_next FROM sb ASOF LEFT JOIN b y ON sb.instrument_id = y.instrument_id AND y.ts <= sb.anchor_ts + INTERVAL 1 DAY),
sm AS (SELECT x.instrument_id, x.ts, x.close, y.ts AS bb_ts, y.close AS bb_close FROM bars_session x ASOF LEFT JOIN mk y ON y.ts <= x.ts)
"""
CUM = "CASE WHEN {t} > s.ba_ts THEN (y.close - a_close) / a_close * 10000 - beta * (({c} - m_close) / m_close * 10000) ELSE (y.close - a_close) / a_close * 10000 END AS cum_bps"
POINTS = """, pts AS (SELECT s.cluster_id, s.instrument_id, s.anchor_ts, y.ts, """ + CUM.format(t="y.bb_ts", c="y.bb_close") + """
  FROM su s JOIN sm y ON s.instrument_id = y.instrument_id AND y.ts > s.a_ts AND y.ts <= {until})
"""
REACHING = "CASE WHEN u_ts <= a_ts AND u_next <= s.anchor_ts + INTERVAL 4 DAY THEN u_next ELSE s.anchor_ts + INTERVAL 1 DAY END"
# minute bars of the loaded window, then closes of days that end after the last of them
LONG = """, dl AS (SELECT instrument_id, ts + to_days(8401) AS ts, close FROM bars_1d), md AS (SELECT ts, close FROM dl WHERE instrument_id = 0),
dd AS (SELECT x.*, y.ts AS bd_ts, y.close AS bd_close FROM dl x ASOF LEFT JOIN md y ON y.ts <= x.ts),
f1 AS (SELECT su.*, y.ts AS f_ts FROM su ASOF JOIN b y ON su.instrument_id = y.instrument_id AND y.ts <= su.anchor_ts + INTERVAL 8 DAY),
f2 AS (SELECT f1.*, y.ts AS bm_ts, y.close AS bm_close FROM f1 ASOF LEFT JOIN mk y ON y.ts <= f1.anchor_ts + INTERVAL 8 DAY),
dj AS (SELECT s.*, y.ts, y.close, CASE WHEN coalesce(bd_ts > bm_ts, bm_ts IS NULL) THEN bd_ts ELSE bm_ts END AS bb_ts, CASE WHEN coalesce(bd_ts > bm_ts, bm_ts IS NULL) THEN bd_close ELSE bm_close END AS bb_close
  FROM f2 s JOIN dd y ON s.instrument_id = y.instrument_id AND y.ts > f_ts AND y.ts <= s.anchor_ts + INTERVAL 30 DAY),
fell AS (SELECT DISTINCT cluster_id FROM abn WHERE horizon = '1d' AND abnormal_bps <= -50),
every AS (SELECT cluster_id, instrument_id, anchor_ts, ts, cum_bps FROM pts UNION ALL SELECT s.cluster_id, s.instrument_id, s.anchor_ts, s.ts, """ + CUM.format(t="s.bb_ts", c="s.bb_close").replace("y.close", "s.close") + """ FROM dj s),
s AS (SELECT *, (epoch_us(ts) - epoch_us(anchor_ts)) / 3600000000 AS hour FROM every SEMI JOIN fell USING (cluster_id) WHERE ts > anchor_ts),
t AS (SELECT cluster_id, min(cum_bps) AS trough, first(hour ORDER BY cum_bps, hour) AS at FROM s GROUP BY 1),
rec AS (SELECT s.cluster_id, instrument_id, trough AS trough_bps, t.at AS hours_to_trough, min(hour) FILTER (WHERE hour > t.at AND cum_bps >= trough / 2) AS hours_to_half,
  min(hour) FILTER (WHERE hour > t.at AND cum_bps >= 0) AS hours_to_full, least(30.0, max(hour) / 24) AS days_used,
  (min(hour) FILTER (WHERE hour > t.at AND cum_bps >= 0)) IS NOT NULL OR least(30.0, max(hour) / 24) >= 29 AS conclusive
FROM s JOIN t USING (cluster_id) WHERE trough < 0 GROUP BY s.cluster_id, instrument_id, trough, t.at)
"""


@query("anchors bars_session bars_1d", LADDER + BETA + MARKET + SIDES + POINTS.format(until="s.anchor_ts + INTERVAL 1 DAY") + "SELECT cluster_id, instrument_id, ts, round(cum_bps, 6) AS cum_bps FROM pts")
def cumulative_series(spark, sf) -> DataFrame:
    points = _series(spark, sf, V.anchors(spark, sf), V.bars_session(spark, sf), 1)
    return points.select("cluster_id", "instrument_id", "ts", r6("cum_bps").alias("cum_bps"))


@query(
    "anchors bars_session bars_1d",
    LADDER + BETA + MARKET + SIDES + POINTS.format(until=REACHING) + """, s AS (SELECT *, abs(cum_bps) AS size, (epoch_us(ts) - epoch_us(anchor_ts)) / 60000000 AS minute, last_value(cum_bps) OVER (PARTITION BY cluster_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS move FROM pts)
SELECT cluster_id, instrument_id, round(first(cum_bps ORDER BY size DESC, ts), 6) AS peak_bps, round(first(minute ORDER BY size DESC, ts), 3) AS minutes_to_peak,
  round(min(minute) FILTER (WHERE abs(move) >= 10 AND size >= abs(move) / 2 AND sign(cum_bps) = sign(move)), 3) AS minutes_to_half,
  CASE WHEN abs(any_value(move)) < 10 THEN 'flat' WHEN any_value(move) > 0 THEN 'up' ELSE 'down' END AS direction, round(any_value(move), 6) AS move_bps, count(*) AS n_points
FROM s GROUP BY 1, 2""",
)
def reaction_summary(spark, sf) -> DataFrame:
    s = study.summary(_series(spark, sf, V.anchors(spark, sf), V.bars_session(spark, sf), 1, extend=True))
    return s.select("cluster_id", "instrument_id", r6("peak_bps").alias("peak_bps"), F.round("minutes_to_peak", 3).alias("minutes_to_peak"), F.round("minutes_to_half", 3).alias("minutes_to_half"), "direction", r6("move_bps").alias("move_bps"), "n_points")


def _daily(spark, sf) -> DataFrame:
    """Daily bars moved to where the minute bars are."""
    return V.bars_1d(spark, sf).withColumn("ts", F.col("ts") + F.make_dt_interval(F.lit(8400)))


@query(
    "anchors bars_session bars_1d",
    LADDER + BETA + ABNORMAL + SIDES + POINTS.format(until="s.anchor_ts + INTERVAL 8 DAY") + LONG
    + "SELECT cluster_id, instrument_id, round(trough_bps, 3) AS trough_bps, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("hours_to_trough", "hours_to_half", "hours_to_full", "days_used")) + ", conclusive FROM rec",
)
def recovery(spark, sf) -> DataFrame:
    """Of falls: over minute bars of eight days, then daily closes up to the thirtieth."""
    anchors, bars = V.anchors(spark, sf), V.bars_session(spark, sf)
    fell = anchors.join(study.falls(_abnormal(spark, sf)), ["cluster_id", "instrument_id"], "left_semi")
    r = study.recovery(_series(spark, sf, fell, bars, C.RECOVERY_DAYS, daily=_daily(spark, sf)))
    return r.select("cluster_id", "instrument_id", F.round("trough_bps", 3).alias("trough_bps"), *[r6(c).alias(c) for c in ("hours_to_trough", "hours_to_half", "hours_to_full", "days_used")], "conclusive")


CREDIBLE = "published_ts >= anchor_ts - INTERVAL 24 HOUR AND published_ts <= anchor_ts + INTERVAL 2 MINUTE"


def credible(received, published):
    """A claim of publication that isn't later than receipt, skew allowed, nor a day older."""
    return (published >= received - F.make_dt_interval(F.lit(1))) & (published <= received + study.minutes(C.SKEW_MINUTES))


# both clocks at once: an anchor of each clock is a story of its own
CLOCKED = f""", two AS (SELECT cluster_id * 2 AS cluster_id, instrument_id, anchor_ts, published_ts, k FROM anchors
  UNION ALL SELECT cluster_id * 2 + 1, instrument_id, published_ts, published_ts, k FROM anchors WHERE {CREDIBLE})
"""


@query(
    "anchors bars_session bars_1d",
    CLOCKED + LADDER.replace("FROM anchors x", "FROM two x") + BETA + ABNORMAL + SIDES + POINTS.format(until="s.anchor_ts + INTERVAL 8 DAY") + LONG
    + """, lo AS (SELECT cluster_id % 2 AS v, count(DISTINCT cluster_id) AS measured, count(*) AS horizons, round(sum(abnormal_bps), 3) AS total_abnormal_bps, count(beta_used) AS with_beta FROM abn GROUP BY 1),
su2 AS (SELECT s.cluster_id % 2 AS v, count(DISTINCT s.cluster_id) AS summaries FROM su s JOIN sm y ON s.instrument_id = y.instrument_id AND y.ts > s.a_ts AND y.ts <= """ + REACHING + """ SEMI JOIN (SELECT cluster_id FROM abn WHERE horizon = '1d') d ON s.cluster_id = d.cluster_id GROUP BY 1),
re2 AS (SELECT cluster_id % 2 AS v, count(*) AS recoveries, round(sum(trough_bps), 3) AS total_trough_bps FROM rec WHERE conclusive GROUP BY 1)
SELECT CASE v WHEN 0 THEN 'm1' ELSE 'm1-pub' END AS measurer_version, measured, horizons, with_beta, total_abnormal_bps, coalesce(summaries, 0) AS summaries, coalesce(recoveries, 0) AS recoveries, total_trough_bps FROM lo LEFT JOIN su2 USING (v) LEFT JOIN re2 USING (v)""",
)
def measure_two_clocks(spark, sf) -> DataFrame:
    """What a measurement writes under each clock; a publication time counts where it is credible."""
    anchors = V.anchors(spark, sf)
    anchors = anchors.withColumn("published_ts", F.when(credible(F.col("anchor_ts"), F.col("published_ts")), F.col("published_ts")))
    rows, summaries, recoveries = study.measure(anchors, V.bars_session(spark, sf), _daily(spark, sf), study.beta(V.bars_1d(spark, sf), V.BENCHMARK), V.BENCHMARK)
    r = rows.groupBy("measurer_version").agg(F.count_distinct("cluster_id").alias("measured"), F.count(F.lit(1)).alias("horizons"), F.count("beta_used").alias("with_beta"), F.round(F.sum("abnormal_bps"), 3).alias("total_abnormal_bps"))
    s = summaries.groupBy("measurer_version").agg(F.count(F.lit(1)).alias("summaries"))
    c = recoveries.groupBy("measurer_version").agg(F.count(F.lit(1)).alias("recoveries"), F.round(F.sum("trough_bps"), 3).alias("total_trough_bps"))
    return r.join(s, "measurer_version", "left").join(c, "measurer_version", "left").fillna(0, ["summaries", "recoveries"])


@query("anchors", f"SELECT instrument_id, min(published_ts) FILTER (WHERE {CREDIBLE}) AS first_published, count(*) FILTER (WHERE {CREDIBLE}) AS n_credible, count(*) AS n FROM anchors GROUP BY 1")
def publication_anchor(spark, sf) -> DataFrame:
    ok = credible(F.col("anchor_ts"), F.col("published_ts"))
    return V.anchors(spark, sf).groupBy("instrument_id").agg(F.min(F.when(ok, F.col("published_ts"))).alias("first_published"), F.count_if(ok).alias("n_credible"), F.count(F.lit(1)).alias("n"))


TWO_CLOCKS = LADDER + """, pa AS (SELECT x.*, y.ts AS pa_ts, y.close AS pa_close, y.next_ts AS pa_next FROM (FROM anchors WHERE published_ts IS NOT NULL) x ASOF JOIN b y ON x.instrument_id = y.instrument_id AND y.ts <= x.published_ts - INTERVAL 1 MINUTE),
pb AS (SELECT * FROM pa WHERE pa_ts >= published_ts - INTERVAL 72 HOUR AND (published_ts - INTERVAL 1 MINUTE - pa_ts <= INTERVAL 30 MINUTE OR pa_next <= published_ts + INTERVAL 8 DAY)),
pp AS (SELECT pb.*, horizon, falls, published_ts + to_minutes(m) AS h_ts FROM pb, hs),
pq AS (SELECT pp.*, y.ts AS b_ts, y.close AS b_close, y.next_ts AS b_next, y.next_close AS b_next_close FROM pp ASOF JOIN b y ON pp.instrument_id = y.instrument_id AND y.ts <= pp.h_ts),
pl AS (SELECT cluster_id, horizon, CASE WHEN b_ts > pa_ts THEN b_close WHEN falls AND b_next <= h_ts + INTERVAL 3 DAY AND b_next <= published_ts + INTERVAL 8 DAY THEN b_next_close END AS used, pa_close
   FROM pq WHERE h_ts - b_ts <= INTERVAL 30 MINUTE OR b_next <= published_ts + INTERVAL 8 DAY),
two AS (SELECT r.cluster_id, r.horizon, r.instrument_id, epoch_us(r.anchor_ts - r.published_ts) / 60000000 AS lag_minutes, r.raw_bps AS received_bps, (used - pa_close) / pa_close * 10000 AS published_bps
  FROM lad r JOIN pl USING (cluster_id, horizon) WHERE used IS NOT NULL)
"""


def _two_clocks(spark, sf) -> DataFrame:
    a, bars = V.anchors(spark, sf), V.bars_session(spark, sf)
    received = study.ladder(a, bars).select("cluster_id", "horizon", "instrument_id", "anchor_ts", "published_ts", F.col("raw_bps").alias("received_bps"))
    published = study.ladder(a, bars, "published_ts").select("cluster_id", "horizon", F.col("raw_bps").alias("published_bps"))
    lag = (F.unix_micros(F.col("anchor_ts").cast("timestamp")) - F.unix_micros(F.col("published_ts").cast("timestamp"))) / 60_000_000
    return received.join(published, ["cluster_id", "horizon"]).withColumn("lag_minutes", lag)


_PRICED = """count(*) AS n, round(quantile_cont(lag_minutes, 0.5), 6) AS median_lag, round(quantile_cont(abs(published_bps) - abs(received_bps), 0.5), 6) AS median_size_gap, round(quantile_cont(published_bps - received_bps, 0.5), 6) AS median_delta"""


def _priced(g) -> DataFrame:
    return g.agg(F.count(F.lit(1)).alias("n"), r6(F.percentile("lag_minutes", 0.5)).alias("median_lag"), r6(F.percentile(F.abs("published_bps") - F.abs("received_bps"), 0.5)).alias("median_size_gap"), r6(F.percentile(F.col("published_bps") - F.col("received_bps"), 0.5)).alias("median_delta"))


@query("anchors bars_session", TWO_CLOCKS + f"SELECT horizon, {_PRICED} FROM two GROUP BY 1")
def latency_by_horizon(spark, sf) -> DataFrame:
    return _priced(_two_clocks(spark, sf).groupBy("horizon"))


@query("anchors bars_session", TWO_CLOCKS + f"SELECT instrument_id, {_PRICED} FROM two GROUP BY 1")
def latency_by_source(spark, sf) -> DataFrame:
    return _priced(_two_clocks(spark, sf).groupBy("instrument_id"))


@query("signals bars_1m", """, b AS (SELECT * FROM bars_1m) SELECT signal_id, y.ts AS quote_ts, y.close AS quote FROM signals x ASOF JOIN b y ON x.instrument_id = y.instrument_id AND y.ts <= x.anchor_ts WHERE x.anchor_ts - y.ts <= INTERVAL 24 HOUR""")
def asof_quote_24h(spark, sf) -> DataFrame:
    got = asof(V.signals(spark, sf), V.bars_1m(spark, sf), ["instrument_id"], "anchor_ts", name="q", max_age_hours=C.QUOTE_AGE_HOURS)
    return got.filter("q IS NOT NULL").select("signal_id", F.col("q.ts").alias("quote_ts"), F.col("q.close").alias("quote"))


@query(
    "signals bars_session",
    """, b AS (SELECT *, lead(ts) OVER (PARTITION BY instrument_id ORDER BY ts) AS next_ts FROM bars_session)
SELECT signal_id, y.ts AS quote_ts, y.close AS quote, x.anchor_ts - y.ts <= INTERVAL 30 MINUTE AS is_fresh FROM signals x ASOF JOIN b y ON x.instrument_id = y.instrument_id AND y.ts <= x.anchor_ts
WHERE x.anchor_ts - y.ts <= INTERVAL 30 MINUTE OR next_ts IS NOT NULL""",
)
def settled_quote(spark, sf) -> DataFrame:
    got = asof(V.signals(spark, sf), with_next(V.bars_session(spark, sf), ["instrument_id"]), ["instrument_id"], "anchor_ts", name="q")
    got = got.filter(study.settled(F.col("anchor_ts"), F.col("q"), C.FRESH_MINUTES))
    return got.select("signal_id", F.col("q.ts").alias("quote_ts"), F.col("q.close").alias("quote"), fresh(F.col("anchor_ts"), F.col("q.ts"), C.FRESH_MINUTES).alias("is_fresh"))


@query(
    "signals bars_session",
    """, s AS (SELECT *, timezone('America/New_York', timezone('UTC', anchor_ts)) AS local FROM signals),
n AS (SELECT *, timezone('UTC', timezone('America/New_York', date_trunc('day', local) + CASE WHEN local - date_trunc('day', local) < INTERVAL '09:30' HOUR TO MINUTE THEN INTERVAL 0 DAY ELSE INTERVAL 1 DAY END + INTERVAL 570 MINUTE)) AS opens FROM s),
c AS (SELECT n.*, y.close AS before FROM n ASOF JOIN bars_session y ON n.instrument_id = y.instrument_id AND y.ts <= n.anchor_ts)
SELECT signal_id, opens AS next_open, y.ts AS bar_ts, round((y.close - before) / before * 10000, 6) AS gap_bps FROM c ASOF JOIN bars_session y ON c.instrument_id = y.instrument_id AND y.ts >= c.opens WHERE y.ts <= opens + INTERVAL 5 DAY""".replace("INTERVAL '09:30' HOUR TO MINUTE", "INTERVAL 570 MINUTE"),
)
def next_open(spark, sf) -> DataFrame:
    """The move from the last bar before a signal to the first one at or after the next opening in New York, five days at most."""
    from tidemark.functions.dates import next_open as opening

    bars = V.bars_session(spark, sf)
    s = V.signals(spark, sf).withColumn("opens", opening(F.col("anchor_ts")))
    s = asof(s, bars, ["instrument_id"], "anchor_ts", name="a").filter("a IS NOT NULL")
    # forward: the successor of the last bar strictly before the opening
    s = s.withColumn("at", F.col("opens") - F.expr("INTERVAL '0.000001' SECOND"))
    got = asof(s, with_next(bars, ["instrument_id"]), ["instrument_id"], "at", name="b").filter((F.col("b.next_ts") >= F.col("opens")) & (F.col("b.next_ts") <= F.col("opens") + study.days(5)))
    return got.select("signal_id", F.col("opens").alias("next_open"), F.col("b.next_ts").alias("bar_ts"), r6(study.return_bps(F.col("a.close"), F.col("b.next_close"))).alias("gap_bps"))
