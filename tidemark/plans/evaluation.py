"""Evaluation reports over scored predictions and measured reactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions import dates, stats
from tidemark.operators import study
from tidemark.operators.asof import asof
from tidemark.plans.sql import with_views
from tidemark.sources import views as V

QUERIES, ORACLES = {}, {}
SHOWN = ("5m", "1h", "1d")

# Signals with the move of their instrument at a few horizons: plain as-of prices, a day at most old.
EVAL = """, pr AS (SELECT s.*, y.close AS p0 FROM signals s ASOF JOIN bars_1m y ON s.instrument_id = y.instrument_id AND y.ts <= s.anchor_ts - INTERVAL 1 MINUTE),
hz(horizon, m) AS (VALUES ('5m', 5), ('1h', 60), ('1d', 1440)),
pz AS (SELECT pr.*, horizon, anchor_ts + to_minutes(m) AS h_ts FROM pr, hz),
mv AS (SELECT z.signal_id, horizon, (y.close - p0) / p0 * 10000 AS bps FROM pz z ASOF JOIN bars_1m y ON z.instrument_id = y.instrument_id AND y.ts <= z.h_ts),
wide AS (SELECT signal_id, max(bps) FILTER (WHERE horizon = '5m') AS m5, max(bps) FILTER (WHERE horizon = '1h') AS h1, max(bps) FILTER (WHERE horizon = '1d') AS d1 FROM mv GROUP BY 1),
loc AS (SELECT *, timezone('America/New_York', timezone('UTC', anchor_ts)) AS lt FROM signals),
er AS (SELECT l.*, m5, h1, d1, CASE WHEN isodow(lt) >= 6 THEN 'weekend' WHEN hour(lt) * 60 + minute(lt) BETWEEN 240 AND 569 THEN 'pre' WHEN hour(lt) * 60 + minute(lt) BETWEEN 570 AND 959 THEN 'rth'
   WHEN hour(lt) * 60 + minute(lt) BETWEEN 960 AND 1199 THEN 'post' ELSE 'overnight' END AS session,
   CASE direction WHEN 'bullish' THEN d1 > 0 WHEN 'bearish' THEN d1 < 0 END AS hit,
   CASE direction WHEN 'bullish' THEN 1 WHEN 'bearish' THEN -1 END AS sgn
   FROM loc l JOIN wide USING (signal_id) WHERE d1 IS NOT NULL)
"""


def eval_rows(spark, sf) -> DataFrame:
    """Signals joined with their pivoted moves, session and hit; those without a move after a day are left out."""
    s, bars = V.signals(spark, sf), V.bars_1m(spark, sf)
    s = s.withColumn("at", F.col("anchor_ts") - study.minutes(1))
    s = asof(s, bars, ["instrument_id"], "at", name="a").filter("a IS NOT NULL").withColumn("p0", F.col("a.close")).drop("a", "at")
    rows = s.withColumn("h", F.explode(study.horizon_frame({h: C.HORIZONS[h] for h in SHOWN}))).select("*", "h.horizon", "h.minutes").drop("h")
    rows = asof(rows.withColumn("at", F.col("anchor_ts") + study.minutes(F.col("minutes"))), bars, ["instrument_id"], "at", name="b")
    move = study.return_bps(F.col("p0"), F.col("b.close"))
    wide = rows.select("signal_id", "horizon", move.alias("bps")).groupBy("signal_id").pivot("horizon", list(SHOWN)).agg(F.max("bps")).toDF("signal_id", "m5", "h1", "d1")
    out = V.signals(spark, sf).join(wide, "signal_id").filter("d1 IS NOT NULL")
    hit = F.when(F.col("direction") == "bullish", F.col("d1") > 0).when(F.col("direction") == "bearish", F.col("d1") < 0)
    return out.withColumns({"session": dates.session(F.col("anchor_ts")), "hit": hit, "sgn": F.when(F.col("direction") == "bullish", 1).when(F.col("direction") == "bearish", -1)})


def query(views: str, sql: str | None, recursive: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(views, sql, recursive) if views else sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


def _rates(g) -> DataFrame:
    """n, hits, rate and its interval over rows that have a hit."""
    d = g.agg(F.count("hit").alias("n"), F.count_if("hit").alias("hits"))
    low, high = stats.wilson(F.col("hits"), F.col("n"))
    return d.withColumns({"rate": r6(F.col("hits") / F.when(F.col("n") > 0, F.col("n"))), "low": r6(low), "high": r6(high)})


W_SQL = """round(hits / nullif(n, 0), 6) AS rate,
 round((hits / nullif(n, 0) + 3.8416 / (2.0 * nullif(n, 0)) - 1.96 * sqrt(hits / nullif(n, 0) * (1 - hits / nullif(n, 0)) / nullif(n, 0) + 3.8416 / (4.0 * n * nullif(n, 0)))) / (1 + 3.8416 / nullif(n, 0)), 6) AS low,
 round((hits / nullif(n, 0) + 3.8416 / (2.0 * nullif(n, 0)) + 1.96 * sqrt(hits / nullif(n, 0) * (1 - hits / nullif(n, 0)) / nullif(n, 0) + 3.8416 / (4.0 * n * nullif(n, 0)))) / (1 + 3.8416 / nullif(n, 0)), 6) AS high"""


def rates_sql(keys: str, source: str = "er", where: str = "true") -> str:
    k = f"{keys}, " if keys else ""
    return f"SELECT {k}n, hits, {W_SQL} FROM (SELECT {k}count(hit) AS n, CAST(count_if(hit) AS BIGINT) AS hits FROM {source} WHERE {where} {'GROUP BY ' + keys if keys else ''})"


@query("signals bars_1m", EVAL + "SELECT signal_id, session, direction, round(m5, 6) AS m5, round(h1, 6) AS h1, round(d1, 6) AS d1, hit FROM er")
def eval_rows_join(spark, sf) -> DataFrame:
    return eval_rows(spark, sf).select("signal_id", "session", "direction", r6("m5").alias("m5"), r6("h1").alias("h1"), r6("d1").alias("d1"), "hit")


@query("scored", f"SELECT b.bucket, n, hits, mean_score, {W_SQL} FROM (SELECT range::INT AS bucket FROM range(10)) b LEFT JOIN (SELECT CAST(least(9, floor(greatest(least(score, 1), 0) * 10)) AS INT) AS bucket, round(avg(score), 6) AS mean_score, count(*) AS n0, CAST(count_if(hit) AS BIGINT) AS h0 FROM scored GROUP BY 1) c ON b.bucket = c.bucket, LATERAL (SELECT coalesce(n0, 0) AS n, coalesce(h0, 0) AS hits)")
def calibration_deciles(spark, sf) -> DataFrame:
    c = stats.calibration(V.scored_outcomes(spark, sf))
    return c.select("bucket", "n", "hits", *[r6(x).alias(x) for x in ("mean_score", "rate", "low", "high")])


@query("scored", "SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(s - r)) / sum(n), 6) AS ece FROM (SELECT least(9, floor(greatest(least(score, 1), 0) * 10)) AS b, count(*) AS n, avg(score) AS s, avg(hit::INT) AS r FROM scored GROUP BY 1)")
def ece(spark, sf) -> DataFrame:
    return stats.calibration_error(V.scored_outcomes(spark, sf)).select("n", r6("ece").alias("ece"))


RANKS = """, v AS (SELECT {by} {x} AS x, {y} AS y FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY {p} ORDER BY x) + (count(*) OVER (PARTITION BY {p}, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY {p} ORDER BY y) + (count(*) OVER (PARTITION BY {p}, y) - 1) / 2 AS ry FROM v)
SELECT {by} count(*) AS n, round(CASE WHEN count(*) >= 3 AND min(rx) < max(rx) AND min(ry) < max(ry) THEN corr(rx, ry) END, 6) AS rho FROM r {group}"""


@query("signals bars_1m", EVAL + RANKS.format(by="session,", x="materiality", y="abs(d1)", source="er", p="session", group="GROUP BY session"))
def spearman_materiality(spark, sf) -> DataFrame:
    s = stats.spearman(eval_rows(spark, sf).select("session", "materiality", F.abs("d1").alias("size")), "materiality", "size", ["session"])
    return s.select("session", "n", r6("rho").alias("rho"))


@query("signals bars_1m", EVAL + RANKS.format(by="", x="confidence", y="d1", source="er", p="1", group=""))
def spearman_confidence(spark, sf) -> DataFrame:
    return stats.spearman(eval_rows(spark, sf), "confidence", "d1").select("n", r6("rho").alias("rho"))


@query("signals bars_1m", EVAL + rates_sql("event_type"))
def event_type_report(spark, sf) -> DataFrame:
    return _rates(eval_rows(spark, sf).groupBy("event_type"))


@query("signals bars_1m", EVAL + rates_sql("session"))
def session_summary(spark, sf) -> DataFrame:
    return _rates(eval_rows(spark, sf).groupBy("session"))


@query("signals bars_1m", EVAL + "SELECT event_type, count(*) AS n, CAST(count_if(abs(d1) < 2000) AS BIGINT) AS quiet, CAST(count_if(abs(d1) >= 100) AS BIGINT) AS big, round(quantile_cont(abs(d1), 0.5), 6) AS median_size FROM er WHERE direction = 'neutral' GROUP BY 1")
def neutral_report(spark, sf) -> DataFrame:
    """Neutral calls hit where the move stays under a threshold; big moves are at least a hundred basis points."""
    r = eval_rows(spark, sf).filter("direction = 'neutral'").groupBy("event_type")
    return r.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs("d1") < 2000).alias("quiet"), F.count_if(F.abs("d1") >= C.BIG_MOVE_BPS).alias("big"), r6(F.percentile(F.abs("d1"), 0.5)).alias("median_size"))


@query("signals bars_1m", EVAL + "SELECT CASE WHEN abs(d1) >= 100 THEN 'big' ELSE 'small' END AS size, count(*) AS n, round(quantile_cont(abs(m5) / nullif(abs(d1), 0), 0.5), 6) AS share_5m, round(quantile_cont(abs(h1) / nullif(abs(d1), 0), 0.5), 6) AS share_1h FROM er GROUP BY 1")
def speed_report(spark, sf) -> DataFrame:
    size = F.when(F.abs("d1") >= C.BIG_MOVE_BPS, "big").otherwise("small")
    whole = F.nullif(F.abs("d1"), F.lit(0.0))
    return eval_rows(spark, sf).groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n"), r6(F.percentile(F.abs("m5") / whole, 0.5)).alias("share_5m"), r6(F.percentile(F.abs("h1") / whole, 0.5)).alias("share_1h"))


@query(
    "signals bars_1m",
    EVAL + """, u AS (SELECT event_type, unnest(['5m', '1h', '1d']) AS horizon, sgn * unnest([m5, h1, d1]) AS drift FROM er WHERE sgn IS NOT NULL)
SELECT event_type, horizon, count(drift) AS n, round(avg(drift), 6) AS mean_drift, round(quantile_cont(drift, 0.5), 6) AS median_drift,
 CASE WHEN count(drift) < 20 THEN 'insufficient' WHEN quantile_cont(drift, 0.5) > 20 THEN 'pass' ELSE 'fail' END AS verdict FROM u GROUP BY 1, 2""",
)
def whitelist_bridge(spark, sf) -> DataFrame:
    """Signed drift after costs by event type and horizon."""
    r = eval_rows(spark, sf).filter("sgn IS NOT NULL").unpivot(["event_type", "sgn"], ["m5", "h1", "d1"], "h", "bps")
    name = F.when(F.col("h") == "m5", "5m").when(F.col("h") == "h1", "1h").otherwise("1d")
    drift = F.col("sgn") * F.col("bps")
    g = r.withColumn("drift", drift).groupBy("event_type", name.alias("horizon")).agg(F.count("drift").alias("n"), F.avg("drift").alias("mean"), F.percentile("drift", 0.5).alias("median"))
    verdict = F.when(F.col("n") < C.BRIDGE_LEAST, "insufficient").when(F.col("median") > C.BRIDGE_COST_BPS, "pass").otherwise("fail")
    return g.select("event_type", "horizon", "n", r6("mean").alias("mean_drift"), r6("median").alias("median_drift"), verdict.alias("verdict"))


CALENDAR = """, sc AS (SELECT s.*, EXISTS (SELECT 1 FROM scheduled c WHERE (c.instrument_id IS NULL OR c.instrument_id = s.instrument_id)
   AND c.scheduled_at BETWEEN s.anchor_ts - INTERVAL 60 MINUTE AND s.anchor_ts + INTERVAL 60 MINUTE) AS calendar_match FROM signals s)
"""


def calendar_flags(spark, sf) -> DataFrame:
    from tidemark.operators.features import calendar_match

    return calendar_match(V.signals(spark, sf), V.scheduled_events(spark, sf), "signal_id", "anchor_ts")


@query("signals scheduled", CALENDAR + "SELECT signal_id, calendar_match FROM sc")
def calendar_match(spark, sf) -> DataFrame:
    return calendar_flags(spark, sf).select("signal_id", "calendar_match")


@query("signals scheduled", CALENDAR + "SELECT already_expected, calendar_match, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM sc GROUP BY 1, 2")
def expected_vs_calendar(spark, sf) -> DataFrame:
    g = calendar_flags(spark, sf).groupBy("already_expected", "calendar_match").agg(F.count(F.lit(1)).alias("n"))
    return g.select("*", r6(F.col("n") / F.sum("n").over(W.partitionBy())).alias("share"))


FLIPS = """, pairs AS (SELECT instrument_id, date_trunc('hour', anchor_ts) AS slot, prompt_version, first(direction ORDER BY signal_id) AS direction FROM signals GROUP BY 1, 2, 3)
"""


def _versions(spark, sf) -> DataFrame:
    s = V.signals(spark, sf).withColumn("slot", F.date_trunc("hour", "anchor_ts"))
    return s.groupBy("instrument_id", "slot", "prompt_version").agg(F.min_by("direction", "signal_id").alias("direction"))


@query("signals", FLIPS + "SELECT a.direction AS direction_a, b.direction AS direction_b, count(*) AS n, CAST(count_if(a.direction <> b.direction) AS BIGINT) AS flips FROM pairs a JOIN pairs b ON a.instrument_id // 2 = b.instrument_id // 2 AND a.slot = b.slot AND a.prompt_version = 'v1' AND b.prompt_version = 'v2' GROUP BY 1, 2")
def version_flips(spark, sf) -> DataFrame:
    p = _versions(spark, sf).withColumn("pair", F.floor(F.col("instrument_id") / 2))
    a = p.filter("prompt_version = 'v1'").select("pair", "slot", F.col("direction").alias("direction_a"))
    b = p.filter("prompt_version = 'v2'").select("pair", "slot", F.col("direction").alias("direction_b"))
    return a.join(b, ["pair", "slot"]).groupBy("direction_a", "direction_b").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("direction_a") != F.col("direction_b")).alias("flips"))


@query("signals", ", p AS (SELECT instrument_id // 2 AS pair, date_trunc('hour', anchor_ts) AS slot FROM signals GROUP BY 1, 2 HAVING count(DISTINCT prompt_version) = 2) SELECT s.prompt_version, count(*) AS n, count(DISTINCT p.slot) AS slots FROM signals s JOIN p ON s.instrument_id // 2 = p.pair AND date_trunc('hour', s.anchor_ts) = p.slot GROUP BY 1")
def version_intersection(spark, sf) -> DataFrame:
    """Only keys that all versions have."""
    s = V.signals(spark, sf).withColumns({"pair": F.floor(F.col("instrument_id") / 2), "slot": F.date_trunc("hour", "anchor_ts")})
    full = s.groupBy("pair", "slot").agg(F.size(F.collect_set("prompt_version")).alias("v")).filter("v = 2")
    return s.join(full.select("pair", "slot"), ["pair", "slot"], "left_semi").groupBy("prompt_version").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("slot").alias("slots"))
