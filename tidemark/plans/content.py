"""Text, duplicate and entity queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions import dates
from tidemark.functions import text as X
from tidemark.operators import entity, similarity
from tidemark.plans.sql import with_views
from tidemark.sources import views as V
from tidemark.storage import checkpoint

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
NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), 'https?://\S+', ' ', 'g'), '[^\p{{L}}\p{{N}}$%.]+', ' ', 'g'), '\s+', ' ', 'g'))"


@query("news_items", f"SELECT item_id, sha256({NORM.format('headline')}) AS headline_hash, length({NORM.format('headline')}) AS n_chars FROM news_items")
def normalised_headlines(spark, sf) -> DataFrame:
    h = X.normalised(F.col("headline"))
    return V.news_items(spark, sf).select("item_id", F.sha2(h, 256).alias("headline_hash"), F.length(h).cast("long").alias("n_chars"))


@query("news_items", f"SELECT sha256({NORM.format("headline || ' ' || body")}) AS content_hash, min(item_id) AS first_item, count(*) AS n FROM news_items GROUP BY 1 HAVING count(*) > 1")
def content_hash_dups(spark, sf) -> DataFrame:
    i = V.news_items(spark, sf).groupBy(X.content_hash(F.col("headline"), F.col("body")).alias("content_hash"))
    return i.agg(F.min("item_id").alias("first_item"), n()).filter("n > 1")


@query("news_items", f"SELECT source, count(*) AS items, count(DISTINCT sha256({NORM.format("headline || ' ' || body")})) AS stories, round(1 - count(DISTINCT sha256({NORM.format("headline || ' ' || body")})) / count(*), 6) AS collapse FROM news_items GROUP BY 1")
def dedup_ratio(spark, sf) -> DataFrame:
    h = V.news_items(spark, sf).select("source", X.content_hash(F.col("headline"), F.col("body")).alias("h"))
    return h.groupBy("source").agg(F.count(F.lit(1)).alias("items"), F.countDistinct("h").alias("stories"), r6(1 - F.countDistinct("h") / F.count(F.lit(1))).alias("collapse"))


@query("news_items", f"SELECT left(any_value({NORM.format('headline')}), 88) AS headline, count(*) AS n, count(DISTINCT source) AS sources FROM news_items GROUP BY sha256({NORM.format('headline')}) ORDER BY n DESC, min(item_id) LIMIT 10")
def top_clusters(spark, sf) -> DataFrame:
    """A report of the ten largest stories."""
    i = V.news_items(spark, sf).groupBy(X.normalised(F.col("headline")).alias("h")).agg(n(), F.countDistinct("source").alias("sources"), F.min("item_id").alias("first"))
    return i.orderBy(F.desc("n"), "first").limit(10).select(F.left("h", F.lit(88)).alias("headline"), "n", "sources")


def _titles(spark, sf) -> DataFrame:
    """Distinct normalised titles of pages, with the least page of each."""
    p = V.table(spark, sf, "pages").select("page_id", X.normalised(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)).alias("title"))
    return p.filter("title <> ''").groupBy("title").agg(F.min("page_id").alias("page_id"))


TITLES = """WITH t AS (SELECT min(page_id) AS page_id, title FROM (SELECT page_id, """ + NORM.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)") + """ AS title FROM pages) WHERE title <> '' GROUP BY title),
"""


@query("", TITLES + r"""w AS (SELECT page_id, unnest(list_filter(regexp_split_to_array(lower(title), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS w FROM t),
g AS (SELECT DISTINCT page_id, substr('  ' || w || ' ', i, 3) AS g FROM w, LATERAL (SELECT unnest(range(1, length(w) + 2)) AS i)), c AS (SELECT page_id, count(*) AS m FROM g GROUP BY 1),
p AS (SELECT x.page_id AS a, y.page_id AS b, count(*) AS s FROM g x JOIN g y ON x.g = y.g AND x.page_id < y.page_id GROUP BY 1, 2)
SELECT a, b, round(s / (ca.m + cb.m - s), 6) AS similarity FROM p JOIN c ca ON ca.page_id = a JOIN c cb ON cb.page_id = b WHERE s / (ca.m + cb.m - s) >= 0.5""")
def trigram_pairs(spark, sf) -> DataFrame:
    t = _titles(spark, sf).withColumn("g", X.trigrams(F.col("title")))
    return similarity.similar_sets(t, "page_id", "g", C.SIMILARITY).select("a", "b", r6("similarity").alias("similarity"))


@query("", TITLES + """s AS (SELECT page_id, list_filter(string_split(title, ' '), lambda x: x <> '') AS w FROM t),
g AS (SELECT DISTINCT page_id, array_to_string(w[i:i + 1], ' ') AS g FROM s, LATERAL (SELECT unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i)), c AS (SELECT page_id, count(*) AS m FROM g GROUP BY 1),
p AS (SELECT x.page_id AS a, y.page_id AS b, count(*) AS s FROM g x JOIN g y ON x.g = y.g AND x.page_id < y.page_id GROUP BY 1, 2)
SELECT a, b, round(s / (ca.m + cb.m - s), 6) AS similarity FROM p JOIN c ca ON ca.page_id = a JOIN c cb ON cb.page_id = b WHERE s / (ca.m + cb.m - s) >= 0.3""")
def shingle_jaccard(spark, sf) -> DataFrame:
    t = _titles(spark, sf).withColumn("g", X.shingles(F.col("title"), 2))
    return similarity.similar_sets(t, "page_id", "g", 0.3).select("a", "b", r6("similarity").alias("similarity"))


# items one by one in order of arrival; the state is the list of clusters and the first cluster of each content hash
LEADERS = """WITH RECURSIVE """ + TITLES[5:] + r"""w AS (SELECT page_id, unnest(list_filter(regexp_split_to_array(lower(title), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS w FROM t),
g AS (SELECT DISTINCT page_id, substr('  ' || w || ' ', i, 3) AS g FROM w, LATERAL (SELECT unnest(range(1, length(w) + 2)) AS i)), c AS (SELECT page_id, count(*) AS m FROM g GROUP BY 1),
p AS (SELECT x.page_id AS a, y.page_id AS b, count(*) AS s FROM g x JOIN g y ON x.g = y.g AND x.page_id <> y.page_id GROUP BY 1, 2),
near AS (SELECT a AS i, list(struct_pack(neg := -s / (ca.m + cb.m - s), o := b)) AS near FROM p JOIN c ca ON ca.page_id = a JOIN c cb ON cb.page_id = b WHERE s / (ca.m + cb.m - s) >= 0.5 GROUP BY a),
it AS (SELECT page_id AS i, sha256(""" + NORM.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)") + r""") AS h, TIMESTAMP '2024-01-01' + to_minutes(page_id * 15) AS t, CASE WHEN page_id % 9 = 0 THEN page_id % 27 END AS cik, row_number() OVER (ORDER BY page_id) AS n FROM pages),
full_it AS (SELECT it.*, near FROM it LEFT JOIN near USING (i)),
st AS (
  SELECT 0::BIGINT AS n, NULL::BIGINT AS i, NULL::BIGINT AS lead, NULL::DOUBLE AS sim, []::STRUCT(lead BIGINT, start TIMESTAMP, last TIMESTAMP, cik BIGINT)[] AS cl, []::STRUCT(h VARCHAR, lead BIGINT)[] AS hs
  UNION ALL
  SELECT n, i, lead, sim,
    CASE WHEN lead = i THEN list_append(cl, struct_pack(lead := i, start := t, last := t, cik := cik)) ELSE list_transform(cl, lambda x: CASE WHEN x.lead = lead THEN struct_pack(lead := x.lead, start := x.start, last := greatest(x.last, t), cik := coalesce(x.cik, cik)) ELSE x END) END,
    CASE WHEN known IS NULL THEN list_append(hs, struct_pack(h := h, lead := lead)) ELSE hs END
  FROM (SELECT *, CASE WHEN same THEN known WHEN best IS NOT NULL THEN best.o ELSE i END AS lead, CASE WHEN NOT same AND best IS NOT NULL THEN -best.neg ELSE 1.0 END AS sim
    FROM (SELECT *, coalesce(len(list_filter(free, lambda x: x.lead = known)) > 0, false) AS same,
        list_sort(list_filter(near, lambda y: len(list_filter(free, lambda x: x.lead = y.o AND t - x.start <= INTERVAL 48 HOUR AND t - x.last <= INTERVAL 48 HOUR)) > 0))[1] AS best
      FROM (SELECT full_it.*, st.cl, st.hs, list_filter(st.hs, lambda x: x.h = full_it.h)[1].lead AS known, list_filter(st.cl, lambda x: full_it.cik IS NULL OR x.cik IS NULL OR x.cik = full_it.cik) AS free
        FROM st JOIN full_it ON full_it.n = st.n + 1))))
SELECT i AS item_id, lead AS leader_id, round(sim, 6) AS similarity FROM st WHERE i IS NOT NULL"""


@query("", LEADERS)
def leader_clusters(spark, sf) -> DataFrame:
    """Pages as news items, a quarter of an hour apart, clustered in order of arrival."""
    p = V.table(spark, sf, "pages").select(F.col("page_id").alias("item_id"), X.normalised(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)).alias("title"))
    p = checkpoint(p)
    received = lambda i: F.lit(V.EPOCH).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col(i).cast("int") * 15)
    t = checkpoint(p.filter("title <> ''").groupBy("title").agg(F.min("item_id").alias("first"))).select("first", X.trigrams(F.col("title")).alias("g"), received("first").alias("at"))
    pairs = similarity.similar_sets(t, "first", "g", C.SIMILARITY, at="at")
    items = p.select("item_id", F.sha2("title", 256).alias("content_hash"), received("item_id").alias("received_at"), F.when(F.col("item_id") % 9 == 0, F.col("item_id") % 27).alias("cik"))
    return similarity.leader_clusters(items, pairs).select("item_id", "leader_id", r6("similarity").alias("similarity"))


STRIP = "html"
for _pattern, _plain in (("(?s)<!--.*?-->", " "), (r"(?is)<script\b[^>]*>.*?</script>", " "), (r"(?is)<style\b[^>]*>.*?</style>", " "), ("<[^>]*>", " ")):
    STRIP = f"regexp_replace({STRIP}, '{_pattern}', '{_plain}', 'g')"
for _pattern, _plain in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " ")):
    STRIP = f"replace({STRIP}, '{_pattern}', '{_plain}')"
STRIP = rf"trim(regexp_replace(regexp_replace(replace({STRIP}, '&#39;', ''''), '[\x{{00a0}}\x{{2007}}\x{{202f}}]', ' ', 'g'), '\s+', ' ', 'g'))"


@query("", f"SELECT page_id, sha256({STRIP}) AS text_hash, length({STRIP}) AS n_chars FROM pages")
def strip_html(spark, sf) -> DataFrame:
    t = V.table(spark, sf, "pages").withColumn("t", X.strip_page(F.col("html")))
    return t.select("page_id", F.sha2("t", 256).alias("text_hash"), F.length("t").cast("long").alias("n_chars"))


@query("", f"SELECT page_id, CASE WHEN left({STRIP}, 1200) <> '' THEN left({STRIP}, 1200) END AS lede FROM pages")
def lede(spark, sf) -> DataFrame:
    return V.table(spark, sf, "pages").select("page_id", X.lede(F.col("html"), F.col("url"), chars=C.LEDE_CHARS).alias("lede"))


@query("", "SELECT session, count(*) AS n FROM (SELECT CASE WHEN isodow(lt) >= 6 THEN 'weekend' WHEN hour(lt) * 60 + minute(lt) BETWEEN 240 AND 569 THEN 'pre' WHEN hour(lt) * 60 + minute(lt) BETWEEN 570 AND 959 THEN 'rth' WHEN hour(lt) * 60 + minute(lt) BETWEEN 960 AND 1199 THEN 'post' ELSE 'overnight' END AS session FROM (SELECT timezone('America/New_York', timezone('UTC', ts)) AS lt FROM events)) GROUP BY 1")
def session_buckets(spark, sf) -> DataFrame:
    return V.table(spark, sf, "events").groupBy(dates.session(F.col("ts")).alias("session")).agg(n())


# News about nations: customers write it, nations are the instruments.
ITEMS = """WITH items AS (SELECT c_custkey AS item_id, CASE c_custkey % 5 WHEN 0 THEN 'Update on ' || n_name || ' today' WHEN 1 THEN 'Trading $' || chr(65 + n_nationkey) || ' higher' WHEN 2 THEN 'Note (NYSE: ' || chr(65 + n_nationkey) || ')' WHEN 3 THEN 'Nothing named' ELSE 'see ' || lower(n_name) || '!' END AS headline,
  CASE WHEN c_custkey % 7 = 0 THEN '$' || chr(65 + (n_nationkey + 1) % 25) || ' falls' ELSE '' END AS body, CASE WHEN c_custkey % 11 = 0 THEN CAST(n_nationkey + 1 AS VARCHAR) END AS cik, n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
"""


def _items(spark, sf) -> DataFrame:
    c = V.table(spark, sf, "customer").join(V.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    letter = lambda x: F.char(x + 65)
    r = F.col("c_custkey") % 5
    head = F.when(r == 0, F.concat(F.lit("Update on "), "n_name", F.lit(" today"))).when(r == 1, F.concat(F.lit("Trading $"), letter(F.col("n_nationkey")), F.lit(" higher"))).when(r == 2, F.concat(F.lit("Note (NYSE: "), letter(F.col("n_nationkey")), F.lit(")"))).when(r == 3, "Nothing named").otherwise(F.concat(F.lit("see "), F.lower("n_name"), F.lit("!")))
    body = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("$"), letter((F.col("n_nationkey") + 1) % 25), F.lit(" falls"))).otherwise("")
    return c.select(F.col("c_custkey").alias("item_id"), head.alias("headline"), body.alias("body"), F.array().cast("array<string>").alias("hints"), F.when(F.col("c_custkey") % 11 == 0, (F.col("n_nationkey") + 1).cast("string")).alias("cik"))


def _dictionary(spark, sf) -> DataFrame:
    nations = V.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("instrument_id"), F.char(F.col("n_nationkey") + 65).alias("symbol"), F.col("n_name").alias("name"), (F.col("n_nationkey") + 1).cast("string").alias("cik"), F.lit("us_equity").alias("asset_class"))
    return entity.aliases_of(nations)


RESOLVED = ITEMS + r"""l AS (SELECT item_id, n_nationkey AS instrument_id, 'cik' AS method, 1.0 AS c FROM items WHERE cik IS NOT NULL
 UNION ALL SELECT item_id, n_nationkey, 'exchange_prefix', 0.9 FROM items WHERE cik IS NULL AND item_id % 5 = 2
 UNION ALL SELECT item_id, n_nationkey, 'cashtag', 0.85 FROM items WHERE cik IS NULL AND item_id % 5 = 1
 UNION ALL SELECT item_id, (n_nationkey + 1) % 25, 'cashtag', 0.85 FROM items WHERE cik IS NULL AND item_id % 7 = 0
 UNION ALL SELECT item_id, n_nationkey, 'name_alias', 0.7 FROM items WHERE cik IS NULL AND item_id % 5 IN (0, 4))
"""


@query("", RESOLVED + "SELECT item_id, CAST(instrument_id AS BIGINT) AS instrument_id, first(method ORDER BY c DESC, method DESC) AS method, CAST(max(c) AS DOUBLE) AS confidence FROM l GROUP BY 1, 2")
def resolve_items(spark, sf) -> DataFrame:
    return entity.resolve(_items(spark, sf), _dictionary(spark, sf))


@query("", RESOLVED + "SELECT method, count(*) AS n, count(DISTINCT item_id) AS items, CAST(count_if(c >= 0.75) AS BIGINT) AS tradable FROM (SELECT item_id, first(method ORDER BY c DESC, method DESC) AS method, max(c) AS c FROM l GROUP BY item_id, instrument_id) GROUP BY 1")
def link_methods(spark, sf) -> DataFrame:
    r = entity.resolve(_items(spark, sf), _dictionary(spark, sf))
    return r.groupBy("method").agg(n(), F.countDistinct("item_id").alias("items"), F.count_if(F.col("confidence") >= C.LINK_CONFIDENCE).alias("tradable"))


@query("", ITEMS + "q AS (SELECT item_id FROM items WHERE NOT (cik IS NOT NULL OR item_id % 5 IN (0, 1, 2, 4) OR item_id % 7 = 0)) SELECT item_id FROM q")
def unlinked_items(spark, sf) -> DataFrame:
    items = _items(spark, sf)
    return items.select("item_id").join(entity.resolve(items, _dictionary(spark, sf)).select("item_id"), "item_id", "left_anti")
