"""Ingestion queries: payloads to rows, polls, keys, calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates
from tidemark.functions import text as X
from tidemark.operators import sinks
from tidemark.plans.sql import with_views
from tidemark.sources import feeds
from tidemark.sources import views as V
from tidemark.streaming import pipelines

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


@query("", """SELECT symbol, ts, open, close, volume FROM (SELECT 'T' || user_id AS symbol, date_trunc('minute', ts)::TIMESTAMP AS ts, value AS open, value + 1 AS close, value * 10 AS volume, event_id FROM events WHERE event_id % 13 <> 0) WHERE ts <= TIMESTAMP '2024-01-20 00:00:00'""")
def snapshot_bars(spark, sf) -> DataFrame:
    """Market snapshots, one a day as the service writes them, back to bars; what hasn't traded or still forms at the poll is left out."""
    e = V.table(spark, sf, "events")
    ms = F.unix_millis(F.date_trunc("minute", "ts"))
    bar = F.struct(F.col("value").alias("o"), F.col("value").alias("h"), F.col("value").alias("l"), (F.col("value") + 1).alias("c"), (F.col("value") * 10).alias("v"), F.when(F.col("event_id") % 13 == 0, F.lit(0)).otherwise(ms).alias("t"))
    day = e.groupBy(F.to_date("ts").alias("day"), F.pmod(F.col("event_id"), F.lit(16)).alias("part")).agg(F.collect_list(F.struct(F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("ticker"), bar.alias("min"))).alias("tickers"))
    payloads = day.select(F.to_json(F.struct(F.lit("OK").alias("status"), "tickers")).alias("payload"))
    now = F.unix_millis(F.lit("2024-01-20 00:01:00").cast("timestamp"))
    return feeds.snapshot(payloads, "payload", now).select("symbol", "ts", "open", "close", "volume")


@query("", "SELECT source, count(*) AS n, count(DISTINCT doc_id) AS ids, CAST(sum(length(regexp_extract(text, '^\\w+'))) AS BIGINT) AS letters FROM documents WHERE lang = 'en' AND regexp_matches(text, '^\\w') GROUP BY 1")
def feed_items(spark, sf) -> DataFrame:
    """English documents as feed entries, written as RSS and read back."""
    d = V.table(spark, sf, "documents").filter((F.col("lang") == "en") & F.col("text").rlike(r"^[A-Za-z0-9_]"))
    word = F.regexp_extract("text", r"^\w+", 0)
    item = F.concat(F.lit("<item><title>"), word, F.lit("</title><link>https://x.example/"), F.col("doc_id").cast("string"), F.lit("</link><guid>"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("</guid><pubDate>Fri, 10 Jul 2026 21:29:00 +0000</pubDate></item>"))
    xml = F.concat(F.lit('<?xml version="1.0"?><rss version="2.0"><channel>'), F.concat_ws("", F.collect_list(item)), F.lit("</channel></rss>"))
    payloads = d.groupBy("source", F.pmod(F.col("doc_id"), F.lit(8)).alias("part")).agg(xml.alias("payload"))
    i = feeds.syndicated(payloads, "payload").withColumns({"source": F.split_part("external_id", F.lit("/"), F.lit(1)), "id": F.split_part("external_id", F.lit("/"), F.lit(2))})
    return i.groupBy("source").agg(n(), F.countDistinct("id").alias("ids"), F.sum(F.length("headline")).cast("long").alias("letters"))


@query("", "SELECT page_id, CAST(len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS INT) AS n_links, CAST(len(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))) AS INT) AS n_distinct, regexp_extract(html, 'lang=\"(\\w+)\"', 1) AS lang FROM pages")
def page_links(spark, sf) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return V.table(spark, sf, "pages").select("page_id", F.size(links).alias("n_links"), F.size(F.array_distinct(links)).alias("n_distinct"), F.regexp_extract("html", r'lang="(\w+)"', 1).alias("lang"))


@query("", "SELECT k, count(*) AS n, round(avg(value), 6) AS mean_value FROM (SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, value FROM events) WHERE k BETWEEN 10 AND 19 GROUP BY 1")
def json_fields(spark, sf) -> DataFrame:
    return V.events(spark, sf).filter(F.col("k").between(10, 19)).groupBy("k").agg(n(), F.round(F.avg("value"), 6).alias("mean_value"))


@query("", "SELECT user_id, count(*) AS n, min(event_id) AS first_event FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id) AS r FROM events) WHERE r = 1 GROUP BY 1")
def overlapping_polls(spark, sf) -> DataFrame:
    """Two polls that overlap by five days, the first write of (user, minute) wins; together they are the whole."""
    e = V.table(spark, sf, "events").withColumn("minute", F.date_trunc("minute", "ts"))
    first = sinks.absent(e.filter(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")), e.limit(0), ["user_id", "minute"], ["ts", "event_id"])
    again = sinks.absent(e.filter(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")), first, ["user_id", "minute"], ["ts", "event_id"])
    return first.unionByName(again).groupBy("user_id").agg(n(), F.min("event_id").alias("first_event"))


@query("", "SELECT source || '/' || '2024-01-0' || (1 + doc_id % 7) || '/' || left(sha256(text), 16) || '-' || left(sha256(CAST(doc_id AS VARCHAR)), 12) || '.json' AS key FROM documents")
def raw_keys(spark, sf) -> DataFrame:
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 7).cast("int"))
    return V.table(spark, sf, "documents").select(sinks.raw_key(F.col("source"), day, F.col("text"), F.col("doc_id").cast("string")).alias("key"))


@query("", "SELECT d::TIMESTAMP AS day, timezone('UTC', timezone('America/New_York', d + INTERVAL 510 MINUTE)) AS release_at FROM (SELECT DISTINCT date_trunc('day', o_orderdate) AS d FROM orders)")
def wall_clock(spark, sf) -> DataFrame:
    """Half past eight in New York on each order date, in UTC, summer and winter."""
    d = V.table(spark, sf, "orders").select(F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("day")).distinct()
    return d.select("day", dates.wall_clock(F.year("day"), F.month("day"), F.day("day"), F.lit(8), F.lit(30)).alias("release_at"))


@query("", "SELECT c.c_custkey, s::DATE AS from_day, least(s + INTERVAL 13 DAY, hi)::DATE AS to_day FROM (SELECT o_custkey AS c_custkey, min(o_orderdate) AS lo, min(o_orderdate) + INTERVAL 40 DAY AS hi FROM orders GROUP BY 1) c, LATERAL (SELECT unnest(generate_series(lo, hi, INTERVAL 14 DAY)) AS s)")
def day_chunks(spark, sf) -> DataFrame:
    """Forty days from each customer's first order in ranges of two weeks."""
    o = V.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.to_date(F.min("o_orderdate")).alias("lo"))
    c = o.withColumn("c", F.explode(dates.chunks(F.col("lo"), F.date_add("lo", 40), 14)))
    return c.select("c_custkey", F.col("c.from").alias("from_day"), F.col("c.to").alias("to_day"))


@query("", "SELECT strftime(o_orderdate, '%Y-%m') AS month, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH, '%Y-%m') AS following, count(*) AS n FROM orders GROUP BY 1, 2")
def months(spark, sf) -> DataFrame:
    m = F.date_format("o_orderdate", "yyyy-MM")
    return V.table(spark, sf, "orders").groupBy(m.alias("month")).agg(n()).select("month", dates.month_after(F.col("month")).alias("following"), "n")


@query("", "SELECT event_id FROM (SELECT *, coalesce(sum(value) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM events WHERE event_type = 'purchase') WHERE before + 50 < 2000")
def within_budget(spark, sf) -> DataFrame:
    q = V.table(spark, sf, "events").filter("event_type = 'purchase'")
    return pipelines.within_budget(q, "value", ["ts", "event_id"], 50.0, 2000.0).select("event_id")


@query("", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN lpad(CAST(c_custkey AS VARCHAR), 10, '0') END AS cik, upper(replace(c_mktsegment, 'E', '.')) AS symbol, left(sha256(c_name), 12) AS short_id FROM customer")
def identifiers(spark, sf) -> DataFrame:
    raw = F.when(F.col("c_custkey") % 4 == 0, F.col("c_custkey").cast("string")).otherwise(F.concat(F.lit("x"), F.col("c_custkey").cast("string")))
    return V.table(spark, sf, "customer").select("c_custkey", X.padded_cik(raw).alias("cik"), X.symbol(F.replace("c_mktsegment", F.lit("E"), F.lit("-"))).alias("symbol"), X.short_id(F.col("c_name"), 12).alias("short_id"))


FILED = """, f AS (SELECT c_custkey AS k, lpad(CAST(c_custkey AS VARCHAR), CAST(5 + c_custkey % 6 AS INT), '0') AS cik,
  ['8-K', '8-K/A', '8-K12B', '10-K', '424B2', 'SC 13D', 'SC 13D/A', '4', NULL][CAST(c_custkey % 9 AS INT) + 1] AS form FROM customer)
"""


@query("", "WITH " + FILED[2:] + """SELECT printf('%010d-24-%06d', k, k) AS external_id, cik, form AS form_type, CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN '2.02' ELSE '2.02,9.1' END AS item_codes
FROM f WHERE form IS NULL OR form LIKE '8-K%'""")
def filing_entries(spark, sf) -> DataFrame:
    """Customers as entries of a feed of filings, written as Atom and read back: the family with its variants, and entries without a form."""
    c = V.table(spark, sf, "customer").withColumn("k", F.col("c_custkey"))
    forms = F.array(*[F.lit(x) for x in ("8-K", "8-K/A", "8-K12B", "10-K", "424B2", "SC 13D", "SC 13D/A", "4", None)])
    form, cik = F.get(forms, (F.col("k") % 9).cast("int")), F.lpad(F.col("k").cast("string"), (5 + F.col("k") % 6).cast("int"), F.lit("0"))
    number = F.format_string("%010d-24-%06d", "k", "k")
    codes = F.when(F.col("k") % 3 == 0, F.lit("no codes")).when(F.col("k") % 3 == 1, F.lit("Item 2.02: Results")).otherwise(F.lit("Item  2.02: Results, Item 9.1, Subitem 7.01"))
    entry = F.concat(F.lit("<entry><title>8-K - "), F.col("c_name"), F.lit(" ("), cik, F.lit(") (Filer)</title><id>urn:tag:x.example,2008:accession-number="), number, F.lit("</id><updated>2024-01-05T10:00:00-05:00</updated><summary>"), codes, F.lit("</summary>"), F.coalesce(F.concat(F.lit('<category term="'), form, F.lit('"/>')), F.lit("")), F.lit("</entry>"))
    payloads = c.groupBy(F.pmod("k", F.lit(16))).agg(F.concat(F.lit('<?xml version="1.0"?><feed>'), F.concat_ws("", F.collect_list(entry)), F.lit("</feed>")).alias("p"))
    return feeds.filings(payloads, "p").select("external_id", "cik", "form_type", F.array_join("item_codes", ",").alias("item_codes"))


@query("", """SELECT 'a' || event_id AS external_id, ts AS published_at, 'S' || user_id % 8 AS hint, (SELECT max(ts) FROM events) AS cursor FROM (SELECT *, date_trunc('second', ts) AS s FROM events) e WHERE ts >= TIMESTAMP '2024-01-09 23:55:00' """.replace("ts AS published_at", "s AS published_at").replace("max(ts)", "max(date_trunc('second', ts))").replace("WHERE ts", "WHERE s"))
def news_articles(spark, sf) -> DataFrame:
    """Events as pages of articles that overlap; from five minutes before the cursor on, once each, with the cursor that follows."""
    e = V.table(spark, sf, "events")
    article = F.struct(F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("title"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_utc"), F.array(F.concat(F.lit("S"), (F.col("user_id") % 8).cast("string"))).alias("tickers"))
    paged = e.withColumn("page", F.explode(F.array_distinct(F.array(F.floor(F.col("event_id") / 100), F.floor((F.col("event_id") + 10) / 100)))))
    payloads = paged.groupBy("page").agg(F.to_json(F.struct(F.lit("OK").alias("status"), F.collect_list(article).alias("results"))).alias("p"))
    out = feeds.news_pages(payloads, "p", "2024-01-10 00:00:00")
    cursor = feeds.news_cursor(payloads, "p", "2024-01-10 00:00:00").select(F.col("cursor").cast("timestamp_ntz"))
    return out.select("external_id", F.col("published_at").cast("timestamp_ntz").alias("published_at"), F.get("hints", F.lit(0)).alias("hint")).crossJoin(F.broadcast(cursor))


@query("", "SELECT CAST(doc_id AS VARCHAR) AS external_id, length(source) AS headline_chars, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS published_at, n_chars AS word_count, CAST(doc_id % 3 AS INT) AS n_keywords FROM documents WHERE doc_id % 5 <> 0")
def archive_items(spark, sf) -> DataFrame:
    """Documents as an archive's months without one section."""
    d = V.table(spark, sf, "documents")
    at = F.date_format(F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("doc_id").cast("int")), "yyyy-MM-dd'T'HH:mm:ss'+0000'")
    words = F.transform(F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), (F.col("doc_id") % 3).cast("int")), lambda v: F.struct(F.lit("subject").alias("name"), v.alias("value")))
    doc = F.struct(F.col("doc_id").cast("string").alias("_id"), F.struct(F.col("source").alias("main")).alias("headline"), at.alias("pub_date"), F.when(F.col("doc_id") % 5 == 0, "Sports").otherwise("World").alias("section_name"), F.col("n_chars").cast("string").alias("word_count"), words.alias("keywords"))
    payloads = d.groupBy(F.pmod("doc_id", F.lit(16))).agg(F.to_json(F.struct(F.struct(F.collect_list(doc).alias("docs")).alias("response"))).alias("p"))
    out = feeds.archive_month(payloads, "p", sections=["sports"])
    return out.select("external_id", F.length("headline").cast("long").alias("headline_chars"), F.col("published_at").cast("timestamp_ntz").alias("published_at"), "word_count", F.size("keywords").alias("n_keywords"))


@query("", "SELECT 'T' || user_id AS symbol, date_trunc('day', ts)::TIMESTAMP AS ts, value AS open, value + 2 AS high, value - 1 AS low, value + 1 AS close, value * 3 AS volume FROM events")
def aggregate_bars(spark, sf) -> DataFrame:
    """Events as pages of daily aggregates, stamped within the day."""
    e = V.table(spark, sf, "events")
    v = F.col("value")
    bar = F.struct(v.alias("o"), (v + 2).alias("h"), (v - 1).alias("l"), (v + 1).alias("c"), (v * 3).alias("v"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t"))
    payloads = e.groupBy("user_id").agg(F.to_json(F.struct(F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("ticker"), F.lit("DELAYED").alias("status"), F.collect_list(bar).alias("results"))).alias("p"))
    return feeds.aggregates(payloads, "p", daily=True).select("symbol", "ts", "open", "high", "low", "close", "volume")


@query("", """SELECT 'X' || user_id % 4 AS pair, date_trunc('minute', ts)::TIMESTAMP AS ts, CAST(round(value, 2) AS DOUBLE) AS close FROM events
WHERE date_trunc('minute', ts) <= TIMESTAMP '2024-01-25'""")
def exchange_candles(spark, sf) -> DataFrame:
    """Events as candles of four pairs; those after the last closed one are left out."""
    e = V.table(spark, sf, "events").withColumn("pair", F.concat(F.lit("X"), (F.col("user_id") % 4).cast("string")))
    price = F.round("value", 2).cast("decimal(18,2)").cast("string")
    candle = F.array(F.unix_seconds(F.date_trunc("minute", "ts").cast("timestamp")).cast("string"), price, price, price, price, price, F.lit("1.5"), F.lit("3"))
    last = F.lit('"last": 1706140800')
    # some 500 candles a response, as exchanges give no more than 720
    payloads = e.groupBy("pair", F.floor(F.col("event_id") / 2048)).agg(F.concat(F.lit('{"error": [], "result": {"'), F.col("pair"), F.lit('": '), F.to_json(F.collect_list(candle)), F.lit(", "), last, F.lit("}}")).alias("p"))
    return feeds.exchange_ohlc(payloads, "p").select("pair", "ts", F.col("close").cast("double").alias("close"))


@query("", """SELECT 'C' || c_custkey AS symbol, timezone('UTC', timezone('America/New_York', o_orderdate + to_minutes(CASE o_orderstatus WHEN 'F' THEN 480 WHEN 'P' THEN 720 ELSE 965 END))) AS scheduled_at,
  CASE o_orderstatus WHEN 'F' THEN 'bmo' WHEN 'P' THEN 'dmh' ELSE 'amc' END AS slot FROM orders JOIN customer ON c_custkey = o_custkey""")
def earnings_slots(spark, sf) -> DataFrame:
    """Orders as reports: before the open, during trade, and after the close where the hour is unknown."""
    o = V.table(spark, sf, "orders")
    hour = F.when(F.col("o_orderstatus") == "F", "bmo").when(F.col("o_orderstatus") == "P", "dmh").otherwise("")
    row = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("symbol"), hour.alias("hour"))
    payloads = o.groupBy(F.pmod("o_orderkey", F.lit(64))).agg(F.to_json(F.struct(F.collect_list(row).alias("earningsCalendar"))).alias("p"))
    return feeds.earnings(payloads, "p").select("symbol", F.col("scheduled_at").cast("timestamp_ntz").alias("scheduled_at"), "slot")


@query("", """SELECT 'S' || s_nationkey AS symbol, lpad(CAST(arg_min(s_suppkey, s_suppkey) AS VARCHAR), 10, '0') AS cik FROM supplier GROUP BY 1""")
def ticker_numbers(spark, sf) -> DataFrame:
    """Suppliers as a map of tickers: the first entry of a symbol wins."""
    s = V.table(spark, sf, "supplier")
    entry = F.struct(F.col("s_suppkey").cast("string").alias("i"), F.struct(F.col("s_suppkey").alias("cik_str"), F.concat(F.lit("s"), F.col("s_nationkey").cast("string")).alias("ticker"), F.col("s_name").alias("title")).alias("e"))
    payloads = s.agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("p"))
    return feeds.ticker_map(payloads, "p")
