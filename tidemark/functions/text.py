"""Text as column expressions: normalisation, hashes, shingles, similarity, stripping, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

URL = r"https?://\S+"
TICKER = r"[A-Z]{1,6}(?:\.[A-Z])?"
EXCHANGES = "NYSE American|NYSE Arca|NYSE|NASDAQ|Nasdaq"
NAME_SUFFIX = r"(?i)[,\s]+(?:incorporated|inc\.?|corporation|corp\.?|company|co\.?|ltd\.?|limited|plc|\(the\)|\(?class [a-z]\)?)$"


def normalised(text: Column) -> Column:
    """Lower case, without addresses; only letters, digits and $ % . stay, single spaces between."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), URL, " "), r"[^\p{L}\p{N}$%.]+", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def content_hash(headline: Column, body: Column) -> Column:
    return F.sha2(normalised(F.concat_ws(" ", headline, body)), 256)


def words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def shingles(text: Column, k: int = 3) -> Column:
    """The set of k-word runs of a normalised text; one run if it is that short, none if it is empty."""
    w = words(text)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), " "))
    return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(runs))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 where either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def trigrams(text: Column) -> Column:
    """Three-character runs of each alphanumeric word, with two blanks before it and one after."""
    w = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    runs = F.transform(w, lambda x: F.transform(F.sequence(F.lit(1), F.length(x) + 1), lambda i: F.substr(F.concat(F.lit("  "), x, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(runs))


ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#0?39;", "'"))


def strip_feed(html: Column) -> Column:
    """Tags and a few entities of short rich text."""
    out = F.regexp_replace(html, "<[^>]*>", " ")
    for pattern, plain in ENTITIES:
        out = F.regexp_replace(out, f"(?i){pattern}", plain)
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def strip_page(html: Column) -> Column:
    """Comments, scripts, styles, hidden filing facts, tags and entities of whole pages."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in ("script", "style", "ix:header", "ix:hidden"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    out = F.regexp_replace(out, "<[^>]*>", " ")
    for pattern, plain in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " ")):
        out = F.replace(out, F.lit(pattern), F.lit(plain))
    out = decode_numeric(out)
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[   ]", " "), r"\s+", " "))


def decode_numeric(text: Column) -> Column:
    """Decimal and hexadecimal character references, the hexadecimal ones first."""

    def replaced(t: Column, pattern: str, base: int) -> Column:
        codes = F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))
        digits = lambda c: F.conv(F.regexp_extract(c, pattern, 1), base, 10).cast("int")
        # a code point as UTF-32 bytes; texts without references skip the fold
        char = lambda c: F.decode(F.unhex(F.lpad(F.hex(digits(c)), 8, "0")), "UTF-32")
        return F.when(t.contains("&#"), F.aggregate(codes, t, lambda acc, c: F.replace(acc, c, char(c)))).otherwise(t)

    return replaced(replaced(text, "(?i)&#x([0-9a-f]+);", 16), "&#([0-9]+);", 10)


def lede(*candidates: Column, chars: int = 1200) -> Column:
    """The first candidate with text, stripped and cut; null if none has any."""
    return F.coalesce(*[F.nullif(F.left(strip_page(c), F.lit(chars)), F.lit("")) for c in candidates])


def mentions(text: Column, alias: str, match_case: bool = False) -> Column:
    """The alias occurs with no letter, digit or underscore on either side."""
    quoted = "\\Q" + alias.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return text.rlike(("(?u)" if match_case else "(?iu)") + rf"(?<![\p{{L}}\p{{N}}_]){quoted}(?![\p{{L}}\p{{N}}_])")


def cashtags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"\$({TICKER})\b"), F.lit(1))


def exchange_tickers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"\b(?:{EXCHANGES})\s*:\s*({TICKER})\b"), F.lit(1))


def padded_cik(raw: Column) -> Column:
    """Ten digits, or null if it isn't one to ten digits."""
    return F.when(raw.rlike("^[0-9]{1,10}$"), F.lpad(raw, 10, "0"))


def stripped_name(name: Column, rounds: int = 4) -> Column:
    """A company's name without legal forms, share classes and a leading article; never empty."""
    out = F.trim(name)
    for _ in range(rounds):
        shorter = F.trim(F.regexp_replace(F.regexp_replace(out, NAME_SUFFIX, ""), r"[,\s]+$", ""))
        out = F.when(shorter == "", out).otherwise(shorter)
    return F.regexp_replace(out, r"(?i)^the\s+(?=\S)", "")


def symbol(raw: Column) -> Column:
    return F.upper(F.translate(F.trim(raw), "-", "."))


def dashed(symbol_: Column) -> Column:
    return F.translate(symbol_, ".", "-")


def composed_key(*parts: str | Column) -> Column:
    return F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts])


def short_id(text: Column, n: int = 32) -> Column:
    return F.substring(F.sha2(text, 256), 1, n)


def redacted(text: Column, secret: str) -> Column:
    return F.replace(text, F.lit(secret), F.lit("***"))
