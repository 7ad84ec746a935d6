"""Relational reports: counts, joins, coverage, funnels, queues, sets, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions import text as X
from tidemark.operators import features, intervals, sinks
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


def r6(c):
    return F.round(c, 6)


def n():
    return F.count(F.lit(1)).alias("n")


@query("", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events e GROUP BY date_trunc('day', e.ts), 2")
def items_per_day(spark, sf) -> DataFrame:
    e = V.table(spark, sf, "events")
    return e.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_type").agg(n(), F.round(F.sum("value"), 4).alias("total"))


@query("", "SELECT * FROM (PIVOT (SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type FROM events) ON event_type IN ('click', 'error', 'purchase', 'signup', 'view') USING count(*) GROUP BY day)")
def day_source_pivot(spark, sf) -> DataFrame:
    """Counts by day and kind, zero where there are none."""
    e = V.table(spark, sf, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"))
    return e.pivot("event_type", ["click", "error", "purchase", "signup", "view"]).count().na.fill(0)


@query("", "SELECT coalesce(event_type, 'ALL') AS event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ROLLUP (event_type)")
def rollup_coverage(spark, sf) -> DataFrame:
    """A total row below the kinds."""
    e = V.table(spark, sf, "events").rollup("event_type").agg(n(), F.countDistinct("user_id").alias("users"))
    return e.select(F.coalesce("event_type", F.lit("ALL")).alias("event_type"), "n", "users")


@query("", "SELECT count(DISTINCT user_id) AS users, count(DISTINCT (user_id, event_type)) AS pairs, CAST(count_if(value > 100) AS BIGINT) AS large, round(quantile_cont(value, 0.5), 6) AS median_value, round(quantile_cont(value, 0.9) FILTER (WHERE event_type = 'purchase'), 6) AS p90_purchase FROM events")
def totals(spark, sf) -> DataFrame:
    e = V.table(spark, sf, "events")
    return e.agg(F.countDistinct("user_id").alias("users"), F.countDistinct(F.struct("user_id", "event_type")).alias("pairs"), F.count_if(F.col("value") > 100).alias("large"), r6(F.percentile("value", 0.5)).alias("median_value"), r6(F.percentile(F.when(F.col("event_type") == "purchase", F.col("value")), 0.9)).alias("p90_purchase"))


@query("", "SELECT n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1")
def four_way_join(spark, sf) -> DataFrame:
    o = V.table(spark, sf, "orders").filter((F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")))
    j = V.table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(V.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(V.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(n(), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("", "SELECT p_brand, count(l_orderkey) AS n, round(coalesce(sum(l_quantity), 0), 2) AS quantity FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_discount >= 0.05 GROUP BY 1")
def gated_left_join(spark, sf) -> DataFrame:
    """The gate is in the join, so parts without such lines stay."""
    li = V.table(spark, sf, "lineitem").filter("l_discount >= 0.05")
    j = V.table(spark, sf, "part").join(li, F.col("l_partkey") == F.col("p_partkey"), "left")
    return j.groupBy("p_brand").agg(F.count("l_orderkey").alias("n"), F.round(F.coalesce(F.sum("l_quantity"), F.lit(0.0)), 2).alias("quantity"))


@query("signals", "SELECT signal_id FROM signals s WHERE NOT EXISTS (SELECT 1 FROM events d WHERE d.event_type = 'view' AND d.user_id % 8 = s.instrument_id AND date_trunc('minute', d.ts) = date_trunc('minute', s.anchor_ts)) ORDER BY anchor_ts, signal_id LIMIT 50")
def undecided_antijoin(spark, sf) -> DataFrame:
    """The fifty oldest signals without a decision in their minute: a queue's batch, its limit is the feature."""
    d = V.table(spark, sf, "events").filter("event_type = 'view'").select((F.col("user_id") % 8).alias("instrument_id"), F.date_trunc("minute", "ts").alias("m"))
    s = V.signals(spark, sf).withColumn("m", F.date_trunc("minute", "anchor_ts"))
    return s.join(d, ["instrument_id", "m"], "left_anti").orderBy("anchor_ts", "signal_id").limit(50).select("signal_id")


@query("", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority IN ('1-URGENT', '2-HIGH')) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def exclusive_semi_anti(spark, sf) -> DataFrame:
    """Keys with some row of a kind and none of another, in one pass over the rows."""
    o = V.table(spark, sf, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("some"), F.bool_or(F.col("o_orderstatus") == "P").alias("other"))
    return o.filter("some AND NOT other").join(V.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select(F.col("o_custkey").alias("c_custkey"))


@query("", "SELECT source, count(*) AS n, CAST(count_if(EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)) AS BIGINT) AS linked, round(count_if(EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)) / count(*), 6) AS coverage FROM documents d GROUP BY 1")
def link_coverage(spark, sf) -> DataFrame:
    """A semi join's outcome as a flag under an aggregate."""
    good = V.table(spark, sf, "labels").filter("quality = 1").select("doc_id").distinct().withColumn("ok", F.lit(True))
    d = V.table(spark, sf, "documents").select("doc_id", "source").join(good, "doc_id", "left")
    return d.groupBy("source").agg(n(), F.count("ok").alias("linked"), r6(F.count("ok") / F.count(F.lit(1))).alias("coverage"))


@query("", "SELECT s_suppkey, first(l_orderkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS best_order, round(max(l_extendedprice), 2) AS best_price FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def arg_max_per_group(spark, sf) -> DataFrame:
    """The row of the largest value for each key, the least id of equals; no sort."""
    li = V.table(spark, sf, "lineitem").join(V.table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    best = F.min_by("l_orderkey", F.struct((-F.col("l_extendedprice")).alias("p"), "l_orderkey", "l_linenumber", "l_partkey"))
    return li.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(best.alias("best_order"), F.round(F.max("l_extendedprice"), 2).alias("best_price"))


@query("", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def first_per_group(spark, sf) -> DataFrame:
    e = V.table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("m"))
    return e.select("user_id", F.col("m.event_id").alias("event_id"), "event_type")


@query("", "SELECT l_returnflag || '/' || l_linestatus AS reason, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, reason LIMIT 5")
def top_skip_reasons(spark, sf) -> DataFrame:
    """A report of the five commonest."""
    return V.table(spark, sf, "lineitem").groupBy(F.concat_ws("/", "l_returnflag", "l_linestatus").alias("reason")).agg(n()).orderBy(F.desc("n"), "reason").limit(5)


@query("", "(SELECT 'best' AS side, o_orderkey, round(o_totalprice, 2) AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 3) UNION ALL (SELECT 'worst', o_orderkey, round(o_totalprice, 2) FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 3)")
def best_and_worst(spark, sf) -> DataFrame:
    """A report of three rows from either end."""
    o = V.table(spark, sf, "orders").select("o_orderkey", F.round("o_totalprice", 2).alias("price"), "o_totalprice")
    best = o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(3).withColumn("side", F.lit("best"))
    return best.unionByName(o.orderBy("o_totalprice", "o_orderkey").limit(3).withColumn("side", F.lit("worst"))).select("side", "o_orderkey", "price")


@query("", "SELECT o_orderkey, o_orderdate FROM orders WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '1996-01-01', 100) ORDER BY o_orderdate, o_orderkey LIMIT 20")
def keyset_page(spark, sf) -> DataFrame:
    """A page after a position; its length is the feature."""
    day = F.lit("1996-01-01").cast("timestamp_ntz")
    o = V.table(spark, sf, "orders").filter((F.col("o_orderdate") > day) | (F.col("o_orderdate") == day) & (F.col("o_orderkey") > 100))
    return o.orderBy("o_orderdate", "o_orderkey").limit(20).select("o_orderkey", "o_orderdate")


@query("", "SELECT l_partkey AS part, l_suppkey AS supplier FROM lineitem WHERE l_returnflag = 'A' UNION SELECT l_partkey, l_suppkey FROM lineitem WHERE l_discount > 0.08")
def union_of_pairs(spark, sf) -> DataFrame:
    """Two sources of pairs, each pair once: one scan with either condition."""
    li = V.table(spark, sf, "lineitem").filter("l_returnflag = 'A' OR l_discount > 0.08")
    return li.select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier")).distinct()


@query("", """SELECT CASE WHEN a.k IS NULL THEN 'only_b' WHEN b.k IS NULL THEN 'only_a' WHEN a.v = b.v THEN 'same' ELSE 'changed' END AS outcome, count(*) AS n
FROM (SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS v FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS v FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1) b ON a.k = b.k GROUP BY 1""")
def compare_runs(spark, sf) -> DataFrame:
    """Two keyed sets: same, changed, and on one side only. The runs are made by leaving out orders."""
    o = V.table(spark, sf, "orders")
    run = lambda m: o.filter(F.col("o_orderkey") % m != 0).groupBy(F.col("o_custkey").alias("k")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    a, b = run(3).alias("a"), run(5).alias("b")
    outcome = F.when(F.col("a.k").isNull(), "only_b").when(F.col("b.k").isNull(), "only_a").when(F.col("a.v") == F.col("b.v"), "same").otherwise("changed")
    return a.join(b, F.col("a.k") == F.col("b.k"), "full_outer").groupBy(outcome.alias("outcome")).agg(n())


@query("membership", "SELECT m.member_id, d.day FROM membership m, (VALUES (TIMESTAMP '1996-06-01'), (TIMESTAMP '1999-06-01'), (TIMESTAMP '2001-06-01')) d(day) WHERE m.valid_from <= d.day AND (m.valid_to IS NULL OR m.valid_to > d.day)")
def membership_asof(spark, sf) -> DataFrame:
    """Members valid at each of a few days."""
    asked = F.array(*[F.lit(d).cast("timestamp_ntz") for d in ("1996-06-01", "1999-06-01", "2001-06-01")])
    m = V.membership(spark, sf).withColumn("day", F.explode(asked))
    return m.filter(intervals.valid_at(F.col("day"), F.col("valid_from"), F.col("valid_to"))).select("member_id", "day")


@query("membership", """, cur AS (SELECT member_id FROM membership WHERE valid_to IS NULL), want AS (SELECT s_suppkey AS member_id FROM supplier WHERE s_acctbal > 4000)
SELECT member_id, 'open' AS change FROM want WHERE member_id NOT IN (SELECT member_id FROM cur) UNION ALL SELECT member_id, 'close' FROM cur WHERE member_id NOT IN (SELECT member_id FROM want)""")
def membership_changes(spark, sf) -> DataFrame:
    want = V.table(spark, sf, "supplier").filter("s_acctbal > 4000").select(F.col("s_suppkey").alias("member_id"))
    return intervals.set_changes(V.membership(spark, sf).filter("valid_to IS NULL"), want, ["member_id"])


@query("membership", """, want AS (SELECT s_suppkey AS member_id FROM supplier WHERE s_acctbal > 4000), opened AS (SELECT member_id FROM want WHERE member_id NOT IN (SELECT member_id FROM membership WHERE valid_to IS NULL))
SELECT member_id, valid_from, CASE WHEN valid_to IS NULL AND member_id NOT IN (SELECT member_id FROM want) THEN TIMESTAMP '2002-01-01' ELSE valid_to END AS valid_to FROM membership UNION ALL SELECT member_id, TIMESTAMP '2002-01-01', NULL FROM opened""")
def universe_sync(spark, sf) -> DataFrame:
    want = V.table(spark, sf, "supplier").filter("s_acctbal > 4000").select(F.col("s_suppkey").alias("member_id"))
    return intervals.apply_versions(V.membership(spark, sf), want, ["member_id"], F.lit("2002-01-01").cast("timestamp_ntz"))


@query("anchors", """, w AS (SELECT instrument_id, anchor_ts - INTERVAL 2 HOUR AS f, anchor_ts + INTERVAL 3 HOUR AS t FROM anchors),
o AS (SELECT *, max(t) OVER (PARTITION BY instrument_id ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w),
i AS (SELECT *, sum(CASE WHEN f <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY instrument_id ORDER BY f, t ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT instrument_id, min(f) AS from_ts, max(t) AS to_ts, count(*) AS n FROM i GROUP BY instrument_id, island""")
def window_coalesce(spark, sf) -> DataFrame:
    """Fetch windows of each instrument, merged where they touch."""
    start, end = intervals.around(F.col("anchor_ts"), 2, 0)
    w = V.anchors(spark, sf).select("instrument_id", start.alias("from_ts"), (end + F.make_dt_interval(F.lit(0), F.lit(3))).alias("to_ts"))
    return intervals.coalesce(w, ["instrument_id"])


@query("anchors", """, w AS (SELECT instrument_id, anchor_ts - INTERVAL 72 HOUR AS f, anchor_ts + INTERVAL 5 DAY AS t FROM anchors UNION ALL SELECT 0, anchor_ts - INTERVAL 72 HOUR, anchor_ts + INTERVAL 5 DAY FROM anchors WHERE instrument_id <> 0),
o AS (SELECT *, max(t) OVER (PARTITION BY instrument_id ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w),
i AS (SELECT *, sum(CASE WHEN f <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY instrument_id ORDER BY f, t ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT instrument_id, min(f) AS from_ts, max(t) AS to_ts, count(*) AS n FROM i GROUP BY instrument_id, island""")
def backfill_plan(spark, sf) -> DataFrame:
    """What to fetch for all stories: their instruments' windows and the benchmark's beside them."""
    start, end = intervals.around(F.col("anchor_ts"))
    own = V.anchors(spark, sf).select("instrument_id", start.alias("from_ts"), end.alias("to_ts"))
    bench = own.filter(F.col("instrument_id") != V.BENCHMARK).withColumn("instrument_id", F.lit(V.BENCHMARK).cast("long"))
    return intervals.coalesce(own.unionByName(bench), ["instrument_id"])


@query("bars_1d", "SELECT instrument_id, count(close * volume) AS n_days, round(CASE WHEN count(close * volume) >= 10 THEN median(close * volume) END, 4) AS median_dollar_volume FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY ts DESC) AS r FROM bars_1d) WHERE r <= 20 GROUP BY 1")
def median_dollar_volume(spark, sf) -> DataFrame:
    m = features.median_dollar_volume(V.bars_1d(spark, sf))
    return m.select("instrument_id", "n_days", F.round("median_dollar_volume", 4).alias("median_dollar_volume"))


@query("anchors", "SELECT cluster_id, count(*) OVER (PARTITION BY instrument_id ORDER BY anchor_ts RANGE BETWEEN INTERVAL '59 minutes 59.999999 seconds' PRECEDING AND CURRENT ROW) AS velocity FROM anchors")
def velocity(spark, sf) -> DataFrame:
    a = V.anchors(spark, sf)
    return a.select("cluster_id", features.velocity(a, ["instrument_id"], "anchor_ts").alias("velocity"))


@query(
    "bars_1d",
    """, tr AS (SELECT instrument_id, ts, row_number() OVER w - 1 AS i, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars_1d WINDOW w AS (PARTITION BY instrument_id ORDER BY ts)),
a(instrument_id, i, atr) AS (SELECT instrument_id, 14::BIGINT, avg(tr) FROM tr WHERE i BETWEEN 1 AND 14 GROUP BY 1 HAVING count(*) = 14 UNION ALL SELECT a.instrument_id, tr.i, (a.atr * 13 + tr.tr) / 14 FROM a JOIN tr ON tr.instrument_id = a.instrument_id AND tr.i = a.i + 1)
SELECT a.instrument_id, max(i) + 1 AS n_bars, round(last(atr ORDER BY i), 4) AS atr FROM a GROUP BY 1""",
    True,
)
def atr(spark, sf) -> DataFrame:
    a = features.wilder_atr(V.bars_1d(spark, sf))
    return a.select("instrument_id", "n_bars", F.round("atr", 4).alias("atr"))


@query("", """SELECT o_custkey AS k, max(o_orderkey) FILTER (WHERE o_orderdate < TIMESTAMP '1998-01-01') AS held, first(o_orderkey ORDER BY o_orderdate, o_orderkey) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-01-01') AS came FROM orders GROUP BY 1
HAVING held IS NULL AND came IS NOT NULL""")
def insert_if_absent(spark, sf) -> DataFrame:
    """Customers' first orders from 1998 on, where the table has none before: the first write of a key wins."""
    o = V.table(spark, sf, "orders")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    new = sinks.absent(o.filter(F.col("o_orderdate") >= cut), o.filter(F.col("o_orderdate") < cut), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return new.select(F.col("o_custkey").alias("k"), F.lit(None).cast("long").alias("held"), F.col("o_orderkey").alias("came"))


@query("", """, o AS (SELECT *, o_orderdate >= TIMESTAMP '1998-01-01' AS late FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY late DESC, o_orderdate DESC, o_orderkey DESC) AS r FROM o) SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS price FROM r WHERE r = 1""".replace(", o AS", "WITH o AS", 1))
def upsert_latest(spark, sf) -> DataFrame:
    o = V.table(spark, sf, "orders")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    none = o.limit(0)
    held = sinks.upserted(none, o.filter(F.col("o_orderdate") < cut), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    out = sinks.upserted(held, o.filter(F.col("o_orderdate") >= cut), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return out.select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("price"))


@query("", "SELECT user_id, CASE WHEN bool_or(event_type = 'error' AND value > 150) THEN greatest(count(*) FILTER (WHERE event_type IN ('view', 'error')), 3) ELSE count(*) FILTER (WHERE event_type IN ('view', 'error')) END AS attempts FROM events WHERE event_type IN ('view', 'error') GROUP BY 1")
def attempt_counters(spark, sf) -> DataFrame:
    """Counters that failures raise, and final failures raise to the cap."""
    e = V.table(spark, sf, "events")
    held = e.filter("event_type = 'view'").groupBy("user_id").agg(F.count(F.lit(1)).alias("attempts"))
    tries = e.filter("event_type = 'error'").select("user_id", (F.col("value") > 150).alias("final"))
    return sinks.counted(held, tries, ["user_id"], C.MODEL_ATTEMPTS)


@query("", "SELECT source, count(*) AS n, count(DISTINCT text) AS distinct_texts, round(1 - count(DISTINCT text) / count(*), 6) AS echo, round(avg(quality), 6) AS good FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def source_reliability(spark, sf) -> DataFrame:
    d = V.table(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h")).join(V.table(spark, sf, "labels"), "doc_id", "left")
    return d.groupBy("source").agg(n(), F.countDistinct("h").alias("distinct_texts"), r6(1 - F.countDistinct("h") / F.count(F.lit(1))).alias("echo"), r6(F.avg("quality")).alias("good"))


@query("anchors", """, h AS (SELECT instrument_id, date_trunc('hour', anchor_ts)::TIMESTAMP AS hour, count(*) AS n FROM anchors a GROUP BY 1, date_trunc('hour', a.anchor_ts)),
b AS (SELECT *, avg(n) OVER (PARTITION BY instrument_id ORDER BY hour ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS usual FROM h) SELECT instrument_id, hour, n, round(usual, 6) AS usual FROM b WHERE n >= 3 * usual""")
def news_bursts(spark, sf) -> DataFrame:
    """Hours with three times the usual number of stories or more."""
    h = V.anchors(spark, sf).groupBy("instrument_id", F.date_trunc("hour", "anchor_ts").cast("timestamp_ntz").alias("hour")).agg(n())
    usual = F.avg("n").over(W.partitionBy("instrument_id").orderBy("hour").rowsBetween(-24, -1))
    return h.withColumn("usual", usual).filter(F.col("n") >= 3 * F.col("usual")).select("instrument_id", "hour", "n", r6("usual").alias("usual"))


@query("", "SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) AS window_start, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2")
def tumbling_windows(spark, sf) -> DataFrame:
    g = V.table(spark, sf, "events").groupBy("event_type", F.window("ts", "6 hours").alias("w")).agg(n(), r6(F.avg("value")).alias("mean_value"))
    return g.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n", "mean_value")


@query("", """, g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS id FROM g) SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, id""".replace(", g AS", "WITH g AS", 1))
def session_windows(spark, sf) -> DataFrame:
    """Groups that close after half a day of silence."""
    e = V.table(spark, sf, "events")
    g = e.groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), n())
    return g.drop("w")


@query("", "SELECT event_type || ':' || user_id || ':v' || (user_id % 2 + 1) AS signal_key, count(*) AS n FROM events WHERE (event_type || ':' || user_id || ':v' || (user_id % 2 + 1)) LIKE '%:v2' GROUP BY 1")
def key_suffix_filter(spark, sf) -> DataFrame:
    e = V.table(spark, sf, "events").withColumn("signal_key", X.composed_key("event_type", "user_id", F.concat(F.lit("v"), (F.col("user_id") % 2 + 1).cast("string"))))
    return e.filter(F.col("signal_key").endswith(":v2")).groupBy("signal_key").agg(n())


@query("", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, round(coalesce(sum(value) FILTER (WHERE event_type = 'purchase'), 0), 4) AS spent, round(sum(sum(value) FILTER (WHERE event_type = 'purchase')) OVER (ORDER BY date_trunc('day', ts)), 4) AS so_far FROM events GROUP BY date_trunc('day', ts)")
def budget_by_day(spark, sf) -> DataFrame:
    d = V.table(spark, sf, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.coalesce(F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))), F.lit(0.0)).alias("s"))
    return d.select("day", F.round("s", 4).alias("spent"), F.round(F.sum("s").over(W.orderBy("day")), 4).alias("so_far"))
