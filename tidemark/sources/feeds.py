"""Payloads of feeds and price services to rows, as column expressions over a text column.

Every parser takes a DataFrame with the payload in one column and fails on
drift (a bad status, misaligned bars) instead of guessing. Payloads are raw
texts, so the same functions serve batch reads, streams and replays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates
from tidemark.functions import text as X

ACCESSION = r"accession-number=(\d{10}-\d{2}-\d{6})"
ACCESSION_ANY = r"(\d{10}-\d{2}-\d{6})"
ITEM_CODE = r"\bItem\s+(\d{1,2}\.\d{1,2})\b"
TITLE_CIK = r"\((\d{5,10})\)"
#: Form families by name: the form and its amendment; of those in PREFIXED all variants that begin with it.
FORMS, PREFIXED = ("8-K", "10-Q", "4", "SC 13D", "SC 13G"), ("8-K",)
#: Pages that one poll follows.
MOST_PAGES = 10
CURSOR_IDS = 500

_LINK = "array<struct<_VALUE: string, _href: string, _rel: string>>"
ATOM = f"entry array<struct<title: string, id: string, link: {_LINK}, summary: string, updated: string, published: string, category: array<struct<_term: string>>, author: struct<name: string>>>"
RSS = "channel struct<item: array<struct<title: string, link: string, guid: string, pubDate: string, description: string, category: array<string>, `dc:creator`: string>>>"


def _iso(text: Column) -> Column:
    """Lenient time to UTC: ISO with offset, or the mail format."""
    mail = F.regexp_replace(F.regexp_replace(text, r"^\w{3},\s*", ""), r"\s+(GMT|UTC|Z)$", " +0000")
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")))


def _href(links: Column) -> Column:
    alternate = F.filter(links, lambda x: x["_rel"].isNull() | (x["_rel"] == "alternate"))
    return F.coalesce(F.get(alternate, F.lit(0))["_href"], F.get(links, F.lit(0))["_href"], F.get(links, F.lit(0))["_VALUE"])


def in_family(form_type: Column, form: str) -> Column:
    """Whether a form belongs to a family; one that the feed doesn't name is taken to."""
    if form not in FORMS:
        raise ValueError(f"no form family {form}")
    own = form_type.startswith(form) if form in PREFIXED else form_type.isin(form, f"{form}/A")
    return form_type.isNull() | own


def walk(fetch, url: str, ids, most: int = MOST_PAGES, strict: bool = False) -> list[str]:
    """Payloads of a response and of the pages that it goes on to, as texts.

    ``fetch(url)`` gives a payload; ``ids(payload)`` what it lists and the next
    page's address, if any. A page that lists nothing new ends the walk, as its
    address then leads in circles. At the bound the rest waits for the next
    poll, whose cursor still lies before it; ``strict`` makes that an error,
    for ranges that no later poll reads again.
    """
    out, seen, at = [], set(), url
    while at is not None and len(out) < most:
        payload = fetch(at)
        listed, following = ids(payload)
        out.append(payload)
        fresh = set(listed) - seen
        seen |= fresh
        at = following if fresh else None
    if at is not None and strict:
        raise ValueError(f"more than {most} pages from {url}")
    return out


def filings(payloads: DataFrame, column: str, form: str = "8-K", cursor: str | None = None) -> DataFrame:
    """(external_id, headline, url, body, published_at, cik, form_type, item_codes, position): entries of a family, newest first, up to the cursor."""
    feed = F.from_xml(F.regexp_replace(F.col(column), r"<\?xml[^>]*\?>", ""), ATOM)
    e = payloads.select(F.posexplode(feed["entry"]).alias("position", "e"))
    url = _href(F.col("e.link"))
    accession = F.coalesce(F.nullif(F.regexp_extract("e.id", ACCESSION, 1), F.lit("")), F.nullif(F.regexp_extract(url, ACCESSION_ANY, 1), F.lit("")))
    out = e.select(
        accession.alias("external_id"), F.trim("e.title").alias("headline"), url.alias("url"), X.strip_feed(F.col("e.summary")).alias("body"), _iso(F.trim("e.updated")).alias("published_at"),
        F.nullif(F.regexp_extract("e.title", TITLE_CIK, 1), F.lit("")).alias("cik"), F.get("e.category", F.lit(0))["_term"].alias("form_type"), F.regexp_extract_all("e.summary", F.lit(ITEM_CODE), F.lit(1)).alias("item_codes"), "position",
    ).filter("external_id IS NOT NULL AND headline IS NOT NULL")
    if cursor is not None:
        stop = out.filter(F.col("external_id") == cursor).agg(F.min("position").alias("stop"))
        out = out.crossJoin(F.broadcast(stop)).filter(F.col("stop").isNull() | (F.col("position") < F.col("stop"))).drop("stop")
    return out.filter(in_family(F.col("form_type"), form))


def syndicated(payloads: DataFrame, column: str) -> DataFrame:
    """RSS 2.0 and Atom by one path: (external_id, headline, url, body, published_at, author, categories)."""
    plain = F.regexp_replace(F.col(column), r"<\?xml[^>]*\?>", "")
    p = payloads.select(plain.alias("p")).withColumn("is_rss", F.col("p").rlike(r"<rss[\s>]"))
    r = p.filter("is_rss").select(F.explode(F.from_xml("p", RSS)["channel"]["item"]).alias("i"))
    rss = r.select(F.coalesce("i.guid", "i.link").alias("external_id"), F.trim("i.title").alias("headline"), F.col("i.link").alias("url"), X.strip_feed(F.col("i.description")).alias("body"), _iso(F.trim("i.pubDate")).alias("published_at"), F.col("i.`dc:creator`").alias("author"), F.coalesce("i.category", F.array().cast("array<string>")).alias("categories"))
    a = p.filter("NOT is_rss").select(F.explode(F.from_xml("p", ATOM)["entry"]).alias("e"))
    url = _href(F.col("e.link"))
    atom = a.select(F.coalesce("e.id", url).alias("external_id"), F.trim("e.title").alias("headline"), url.alias("url"), X.strip_feed(F.col("e.summary")).alias("body"), _iso(F.trim(F.coalesce("e.published", "e.updated"))).alias("published_at"), F.col("e.author.name").alias("author"), F.transform(F.coalesce("e.category", F.array().cast("array<struct<_term:string>>")), lambda c: c["_term"]).alias("categories"))
    return rss.unionByName(atom).filter("external_id IS NOT NULL AND headline IS NOT NULL")


def next_cursor(current: Column, seen: Column) -> Column:
    """Ids of this poll and then earlier ones, once each, bounded."""
    return F.slice(F.array_distinct(F.concat(current, seen)), F.lit(1), F.lit(CURSOR_IDS))


NEWS = "status string, next_url string, results array<struct<id: string, title: string, description: string, author: string, article_url: string, published_utc: string, tickers: array<string>, keywords: array<string>, publisher: struct<name: string>>>"


def later(cursor: Column, seen: Column) -> Column:
    """A cursor of time moves forward only: the later of both, null-safe."""
    return F.greatest(cursor, seen)


def news_cursor(payloads: DataFrame, column: str, cursor: str | None = None) -> DataFrame:
    """(cursor): the latest time of publication of all pages, or the present cursor where that is later."""
    r = payloads.select(F.explode_outer(F.from_json(column, NEWS)["results"]).alias("r"))
    now = F.lit(cursor).cast("timestamp")
    return r.agg(later(now, F.max(_iso(F.col("r.published_utc")))).alias("cursor"))


def news_pages(payloads: DataFrame, column: str, cursor: str | None = None, overlap_minutes: int = 5) -> DataFrame:
    """Articles of paged responses, once each, from a few minutes before the cursor on; a status other than OK is an error."""
    p = payloads.select(F.from_json(column, NEWS).alias("p"))
    ok = F.when(F.col("p.status") == "OK", F.col("p.status")).otherwise(F.raise_error("news response without status OK").cast("string"))
    r = p.select(ok.alias("status"), F.explode("p.results").alias("r")).filter("status = 'OK'")
    out = r.select(F.col("r.id").alias("external_id"), F.col("r.title").alias("headline"), F.col("r.description").alias("body"), F.col("r.article_url").alias("url"), _iso(F.col("r.published_utc")).alias("published_at"), F.coalesce("r.tickers", F.array().cast("array<string>")).alias("hints"), F.col("r.publisher.name").alias("publisher")).dropDuplicates(["external_id"])
    if cursor is not None:
        out = out.filter(F.col("published_at") >= F.lit(cursor).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(overlap_minutes)))
    return out


ARCHIVE = "response struct<docs: array<struct<_id: string, web_url: string, abstract: string, snippet: string, pub_date: string, section_name: string, document_type: string, type_of_material: string, headline: struct<main: string, kicker: string>, word_count: string, keywords: array<struct<name: string, value: string>>>>>"


def archive_month(payloads: DataFrame, column: str, sections: list[str] = (), materials: list[str] = (), kinds: list[str] = ()) -> DataFrame:
    """Documents of a month's archive without excluded sections, materials and kinds; backfilled, so their own time counts as received."""
    d = payloads.select(F.explode(F.from_json(column, ARCHIVE)["response"]["docs"]).alias("d"))
    for field, out in (("section_name", sections), ("type_of_material", materials), ("document_type", kinds)):
        d = d.filter(~F.lower(F.coalesce(f"d.{field}", F.lit(""))).isin(*[x.lower() for x in out])) if out else d
    at = F.coalesce(F.try_to_timestamp("d.pub_date", F.lit("yyyy-MM-dd'T'HH:mm:ssZ")), F.try_to_timestamp("d.pub_date"))
    words = F.expr("try_cast(d.word_count AS BIGINT)")
    out = d.select(F.col("d._id").alias("external_id"), F.trim("d.headline.main").alias("headline"), F.trim(F.coalesce("d.abstract", "d.snippet", F.lit(""))).alias("body"), F.col("d.web_url").alias("url"), at.alias("published_at"), at.alias("received_at"), words.alias("word_count"), F.filter(F.transform(F.coalesce("d.keywords", F.array().cast("array<struct<name:string,value:string>>")), lambda k: k["value"]), lambda v: v != "").alias("keywords"))
    return out.filter("headline IS NOT NULL AND headline <> '' AND published_at IS NOT NULL")


def last_complete_month(now) -> str:
    """The newest month that an archive serves: the one before ``now``'s."""
    return f"{now.year - (now.month == 1):04d}-{(now.month - 2) % 12 + 1:02d}"


def archive_next(cursor: str | None, start: str, now) -> str | None:
    """The month to fetch after the last one that was taken, or none when the archive has no later one that is complete."""
    import re

    for month in (cursor, start):
        if month is not None and not re.fullmatch(r"\d{4}-(0[1-9]|1[0-2])", month):
            raise ValueError(f"a month must read YYYY-MM, not {month}")
    if cursor is None:
        following = start
    else:
        year, month = int(cursor[:4]), int(cursor[5:])
        following = f"{year + month // 12:04d}-{month % 12 + 1:02d}"
    return following if following <= last_complete_month(now) else None


SNAPSHOT = "status string, tickers array<struct<ticker: string, min: struct<o: double, h: double, l: double, c: double, v: double, t: bigint>>>"


def _checked(value: Column, ok: Column, message: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(message).cast("bigint"))


def snapshot(payloads: DataFrame, column: str, now_ms: Column, symbols: DataFrame | None = None) -> DataFrame:
    """A minute bar of each symbol of a market snapshot: none that hasn't traded or is still forming."""
    p = payloads.select(F.from_json(column, SNAPSHOT).alias("p"), now_ms.alias("now"))
    p = p.withColumn("now", _checked(F.col("now"), F.col("p.status").isin("OK", "DELAYED"), "snapshot without a good status"))
    t = p.select("now", F.explode("p.tickers").alias("t")).filter("t.min IS NOT NULL AND t.min.t <> 0").filter(F.col("now") - F.col("t.min.t") >= 60_000)
    if symbols is not None:
        t = t.join(symbols.select(F.col("symbol").alias("_s")).distinct(), F.col("t.ticker") == F.col("_s"), "left_semi")
    ms = _checked(F.col("t.min.t"), F.col("t.min.t") % 60_000 == 0, "a minute bar must begin with a minute")
    return t.select(F.col("t.ticker").alias("symbol"), F.timestamp_millis(ms).cast("timestamp_ntz").alias("ts"), *[F.col(f"t.min.{k}").alias(v) for k, v in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"), ("v", "volume"))])


AGGREGATES = "ticker string, status string, next_url string, results array<struct<o: double, h: double, l: double, c: double, v: double, t: bigint>>"


def aggregates(payloads: DataFrame, column: str, daily: bool = False) -> DataFrame:
    """Bars of paged aggregates; a bad status is an error, minutes must be aligned, days are cut to the UTC day."""
    p = payloads.select(F.from_json(column, AGGREGATES).alias("p"))
    b = p.select("p.ticker", "p.status", F.explode("p.results").alias("b"))
    b = b.withColumn("b", F.col("b").withField("t", _checked(F.col("b.t"), F.coalesce(F.col("status").isin("OK", "DELAYED"), F.lit(False)), "aggregates without a good status")))
    ms = F.col("b.t") - F.col("b.t") % 86_400_000 if daily else _checked(F.col("b.t"), F.col("b.t") % 60_000 == 0, "a minute bar must begin with a minute")
    return b.select(F.col("ticker").alias("symbol"), F.timestamp_millis(ms).cast("timestamp_ntz").alias("ts"), *[F.col(f"b.{k}").alias(v) for k, v in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"), ("v", "volume"))])


def exchange_ohlc(payloads: DataFrame, column: str, interval_minutes: int = 1) -> DataFrame:
    """Candles of an exchange's one pair, without the one that still forms; errors, several pairs and misaligned times fail."""
    result = F.from_json(F.get_json_object(column, "$.result"), "map<string,string>")
    p = payloads.select(F.from_json(F.get_json_object(column, "$.error"), "array<string>").alias("error"), result.alias("r"))
    pairs = F.filter(F.map_keys("r"), lambda k: k != "last")
    last = _checked(F.element_at("r", F.lit("last")).cast("bigint"), (F.size(F.coalesce("error", F.array().cast("array<string>"))) == 0) & (F.size(pairs) == 1), "exchange response with errors or without exactly one pair")
    rows = F.from_json(F.element_at("r", F.get(pairs, F.lit(0))), "array<array<string>>")
    # what a whole response says is settled before its candles are rows: beside an explode it would be worked out, and the response copied, for each of them
    whole = p.select(last.alias("last"), F.get(pairs, F.lit(0)).alias("pair"), rows.alias("rows"))
    c = whole.select("last", "pair", F.explode("rows").alias("c")).withColumn("t", F.get("c", F.lit(0)).cast("bigint")).filter("t <= last")
    step = interval_minutes * 60
    t = _checked(F.col("t"), F.col("t") % step == 0, "a candle must begin with its interval")
    return c.select("pair", F.timestamp_seconds(t).cast("timestamp_ntz").alias("ts"), *[F.get("c", F.lit(i)).cast("decimal(18,6)").alias(v) for i, v in ((1, "open"), (2, "high"), (3, "low"), (4, "close"))], F.get("c", F.lit(6)).cast("decimal(20,4)").alias("volume"))


EARNINGS = "earningsCalendar array<struct<date: string, symbol: string, hour: string, year: int, quarter: int, epsEstimate: double>>"
#: Local times of the slots of a day, in minutes.
SLOTS = {"bmo": 480, "amc": 965, "dmh": 720}
ROW_CAP = 1500


def earnings(payloads: DataFrame, column: str) -> DataFrame:
    """(symbol, scheduled_at, slot): the slot's local time of the day, in UTC."""
    e = payloads.select(F.explode(F.from_json(column, EARNINGS)["earningsCalendar"]).alias("e")).filter("e.symbol <> ''")
    slot = F.when(F.col("e.hour").isin(*SLOTS), F.col("e.hour")).otherwise("amc")
    minutes = F.element_at(F.create_map(*[x for k, v in SLOTS.items() for x in (F.lit(k), F.lit(v))]), slot)
    at = F.to_timestamp_ntz("e.date", F.lit("yyyy-MM-dd")) + F.make_dt_interval(F.lit(0), F.lit(0), minutes)
    return e.select(X.symbol(F.col("e.symbol")).alias("symbol"), dates.utc(at).alias("scheduled_at"), slot.alias("slot"), F.col("e.epsEstimate").alias("eps_estimate"))


def plan_ranges(start, end, count, days: int = 14, cap: int = ROW_CAP) -> list[tuple]:
    """Ranges of at most ``days`` days whose ``count(from, to)`` stays below the cap, halved as often as needed; a day at the cap fails."""
    from datetime import timedelta

    todo, out = [], []
    at = start
    while at <= end:
        todo.append((at, min(at + timedelta(days=days - 1), end)))
        at += timedelta(days=days)
    while todo:
        a, b = todo.pop(0)
        if count(a, b) < cap:
            out.append((a, b))
        elif a == b:
            raise ValueError(f"{a} alone reaches the row cap")
        else:
            mid = a + (b - a) // 2
            todo[:0] = [(a, mid), (mid + timedelta(days=1), b)]
    return out


def ticker_map(payloads: DataFrame, column: str) -> DataFrame:
    """(symbol, cik): the first entry of a ticker wins; numbers padded to ten digits."""
    m = F.from_json(column, "map<string, struct<cik_str: bigint, ticker: string, title: string>>")
    e = payloads.select(F.explode(m).alias("i", "e")).select(F.col("i").cast("int").alias("i"), F.upper("e.ticker").alias("symbol"), F.lpad(F.col("e.cik_str").cast("string"), 10, "0").alias("cik"))
    return e.groupBy("symbol").agg(F.min_by("cik", "i").alias("cik"))


def looked_up(symbols: DataFrame, ciks: DataFrame) -> DataFrame:
    """Symbols with their numbers, found as written or with dashes for dots."""
    c = ciks.select(F.col("symbol").alias("_s"), "cik")
    direct = symbols.join(c, F.col("symbol") == F.col("_s"), "left").drop("_s")
    other = c.select(F.col("_s").alias("_d"), F.col("cik").alias("_c"))
    return direct.join(other, X.dashed(F.col("symbol")) == F.col("_d"), "left").withColumn("cik", F.coalesce("cik", "_c")).drop("_d", "_c")


def document_texts(documents: DataFrame, per_document: int = 40_000, per_filing: int = 80_000) -> DataFrame:
    """Texts of a filing's documents (filing_id, position, name, html) in order, cut so that each and all together stay in bounds; indexes and data files are left out."""
    from pyspark.sql import Window as W

    wanted = documents.filter(F.col("name").rlike(r"(?i)\.html?$") & ~F.col("name").rlike(r"(?i)index|^R\d+\.|xbrl|_(cal|def|lab|pre)\."))
    t = wanted.withColumn("text", F.left(X.strip_page(F.col("html")), F.lit(per_document)))
    w = W.partitionBy("filing_id").orderBy("position")
    t = t.withColumns({"_n": F.row_number().over(w), "_used": F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))}).filter("_n <= 4")
    return t.withColumn("text", F.left("text", F.greatest(F.lit(per_filing) - F.col("_used"), F.lit(0)).cast("int"))).filter("text <> ''").select("filing_id", "position", "name", "text")
