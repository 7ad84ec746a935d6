"""Entity resolution: five ways from a news item to instruments, the best of each kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import constants as C
from tidemark.functions import text as X

LEAST_HINT, LEAST_ALIAS = 3, 4


def resolve(items: DataFrame, aliases: DataFrame) -> DataFrame:
    """(item_id, instrument_id, method, confidence), one row for each item and instrument.

    Items: item_id, headline, body, hints (array of symbols), cik (null unless
    a filing). Aliases: alias, kind (ticker, cik, name), instrument_id,
    asset_class. A filing resolves by its number alone. Otherwise: vendor hints
    of three letters or more; tickers after an exchange's name; cashtags; crypto
    tickers as words, case kept; names in the headline, at words' borders,
    short ones only with a digit and in their case, generic words never.
    Names are matched by their words: an item meets only aliases that begin
    with a word of its headline.
    """
    conf = C.LINK_METHODS
    tick = aliases.filter("kind = 'ticker'").select(F.col("alias").alias("_sym"), F.col("instrument_id"), "asset_class")
    number = aliases.filter("kind = 'cik'").select(F.col("alias").alias("_cik"), "instrument_id")
    filing = items.withColumn("_c", X.padded_cik(F.col("cik")))
    by_cik = filing.filter("_c IS NOT NULL").join(number, F.col("_c") == F.col("_cik")).select("item_id", "instrument_id", F.lit("cik").alias("method"))
    rest = filing.filter(F.col("cik").isNull())
    text = F.concat_ws(" ", "headline", "body")

    def symbols(found, method: str) -> DataFrame:
        s = rest.select("item_id", F.explode(F.array_distinct(found)).alias("_s"))
        return s.join(tick, F.col("_s") == F.col("_sym")).select("item_id", "instrument_id", F.lit(method).alias("method"))

    hints = symbols(F.filter(F.coalesce("hints", F.array().cast("array<string>")), lambda h: F.length(h) >= LEAST_HINT), "source_hint")
    exchange, cash = symbols(X.exchange_tickers(text), "exchange_prefix"), symbols(X.cashtags(text), "cashtag")
    word = lambda c: F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    heads = rest.select("item_id", "headline", F.explode(F.array_distinct(F.transform(word(F.col("headline")), F.lower))).alias("_w"))
    names = aliases.filter("kind = 'name' OR (kind = 'ticker' AND asset_class = 'crypto')").withColumn("_a", F.trim("alias"))
    short = (F.length("_a") < LEAST_ALIAS) & (F.col("kind") == "name")
    names = names.filter(~(short & ~F.col("_a").rlike("[0-9]")) & ~((F.col("kind") == "name") & F.lower("_a").isin(*C.GENERIC_ALIASES)))
    names = names.withColumns({"_cased": short | (F.col("kind") == "ticker"), "_first": F.lower(F.regexp_extract("_a", r"([\p{L}\p{N}_]+)", 1))})
    pattern = F.concat(F.when(F.col("_cased"), "(?u)").otherwise("(?iu)"), F.lit(r"(?<![\p{L}\p{N}_])\Q"), F.col("_a"), F.lit(r"\E(?![\p{L}\p{N}_])"))
    met = heads.join(names, F.col("_w") == F.col("_first")).filter(F.regexp_like("headline", pattern))
    method = F.when(F.col("asset_class") == "crypto", "crypto_keyword").otherwise("name_alias")
    named = met.select("item_id", "instrument_id", method.alias("method"))
    every = by_cik.unionByName(hints).unionByName(exchange).unionByName(cash).unionByName(named)
    score = F.create_map(*[x for k, v in conf.items() for x in (F.lit(k), F.lit(v))])
    scored = every.withColumn("confidence", F.element_at(score, F.col("method")))
    best = scored.groupBy("item_id", "instrument_id").agg(F.max_by("method", F.struct("confidence", "method")).alias("method"), F.max("confidence").alias("confidence"))
    return best


def aliases_of(instruments: DataFrame) -> DataFrame:
    """Ticker, cashtag, padded number, full name and stripped name of each instrument (instrument_id, symbol, name, cik, asset_class)."""
    each = F.array(
        F.struct(F.col("symbol").alias("alias"), F.lit("ticker").alias("kind")), F.struct(F.concat(F.lit("$"), F.col("symbol")).alias("alias"), F.lit("cashtag").alias("kind")),
        F.struct(X.padded_cik(F.col("cik")).alias("alias"), F.lit("cik").alias("kind")), F.struct(F.col("name").alias("alias"), F.lit("name").alias("kind")), F.struct(X.stripped_name(F.col("name")).alias("alias"), F.lit("name").alias("kind")),
    )
    return instruments.withColumn("_a", F.explode(each)).select("_a.alias", "_a.kind", "instrument_id", "asset_class").filter("alias IS NOT NULL AND alias <> ''").distinct()


def promote(links: DataFrame, answers: DataFrame, confidence: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(links to add, one verdict an item): of a scorer's answers only candidates count.

    Links: item_id, instrument_id. Answers: item_id, instruments (array). An
    item whose answer confirms nothing still gets its verdict.
    """
    cand = links.groupBy("item_id").agg(F.collect_set("instrument_id").alias("candidates"))
    both = answers.join(cand, "item_id").withColumn("confirmed", F.array_distinct(F.array_intersect("instruments", "candidates")))
    new = both.select("item_id", F.explode("confirmed").alias("instrument_id"), F.lit("llm_ner").alias("method"), F.lit(confidence).alias("confidence"))
    return new, both.select("item_id", F.size("confirmed").alias("n_confirmed"))


def discovered(judgments: DataFrame, universe: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, counts) of judgments that name companies (judgment_id, scope, companies: array of (symbol, direction, materiality, move_bps)).

    A row for each named company of the universe (symbol, instrument_id),
    whatever the letters' case; what isn't in it is dropped and counted:
    (judgment_id, n_known, n_unknown). Scope ``none`` gives neither.
    """
    named = judgments.filter("scope <> 'none'").select("judgment_id", F.explode_outer("companies").alias("c"))
    known = universe.select(F.upper("symbol").alias("_s"), "symbol", "instrument_id")
    each = named.join(known, F.upper("c.symbol") == F.col("_s"), "left")
    rows = each.filter("instrument_id IS NOT NULL").select("judgment_id", "instrument_id", "symbol", "c.direction", "c.materiality", "c.move_bps")
    counts = each.groupBy("judgment_id").agg(F.count("instrument_id").alias("n_known"), F.count_if(F.col("c").isNotNull() & F.col("instrument_id").isNull()).alias("n_unknown"))
    return rows, counts


def identified(constituents: DataFrame, numbers: DataFrame, known: DataFrame) -> DataFrame:
    """Constituents (symbol, cik, ...) with the registrant number of ``numbers`` (symbol, cik) before their own.

    A symbol that ``known`` (symbol, cik) holds with another number is an
    error: its links belong to another company.
    """
    from tidemark.sources.feeds import looked_up

    found = looked_up(constituents.select("symbol").distinct(), numbers).select(F.col("symbol").alias("_s"), F.col("cik").alias("_cik"))
    held = known.filter("cik IS NOT NULL").select(F.col("symbol").alias("_k"), F.col("cik").alias("_held"))
    both = constituents.join(found, F.col("symbol") == F.col("_s"), "left").join(held, F.col("symbol") == F.col("_k"), "left")
    cik = F.coalesce("_cik", "cik")
    why = F.concat(F.lit("another number for the symbol "), F.col("symbol"), F.lit(": "), F.col("_held"), F.lit(", now "), F.coalesce(cik, F.lit("none")))
    sure = F.when(F.col("_held").isNotNull() & ~cik.eqNullSafe(F.col("_held")), F.raise_error(why).cast("string")).otherwise(cik)
    return both.withColumn("cik", sure).drop("_s", "_cik", "_k", "_held")


def fan_out(judgments: DataFrame, universe: DataFrame) -> DataFrame:
    """A row for each instrument of each sector that a judgment names (judgment_id, anchor_ts, expected_move_bps, sectors: array of (sector, materiality)).

    Only members at the anchor count; moves scale by materiality over the
    judgment's largest, to two decimals; the rows of a judgment share equal
    weights. Universe: instrument_id, sector, valid_from, valid_to.
    """
    peak = F.array_max(F.transform("sectors", lambda s: s["materiality"]))
    j = judgments.withColumn("_peak", peak).withColumn("_s", F.explode("sectors"))
    hit = j.join(universe, F.col("_s.sector") == F.col("sector")).filter((F.col("valid_from") <= F.col("anchor_ts")) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("anchor_ts"))))
    move = F.round(F.col("expected_move_bps") * F.col("_s.materiality") / F.col("_peak"), 2)
    rows = hit.groupBy("judgment_id", "instrument_id").agg(F.max(move).alias("move_bps"))
    count = rows.groupBy("judgment_id").agg((1 / F.count(F.lit(1))).alias("weight"))
    return rows.join(count, "judgment_id")
