"""Tables of web pages to rows: one page in, its rows out, by the standard library's parser in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import dates

MONTHS = {m: i + 1 for i, m in enumerate("january february march april may june july august september october november december".split())}


class _Tables(HTMLParser):
    """Cells of all tables, by table, row and column; headings between them count as context."""

    def __init__(self, css_class: str | None):
        super().__init__()
        self.css, self.rows, self.table, self.row, self.cell, self.heading, self.depth = css_class, [], -1, None, None, "", 0
        self.in_heading = False

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
            if self.css is None or self.css in (dict(attrs).get("class") or "").split():
                self.table += 1
        elif tag == "tr" and self.depth and self.table >= 0:
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.cell = []
        elif tag in ("h1", "h2", "h3", "h4", "caption"):
            self.heading, self.in_heading = "", True

    def handle_endtag(self, tag):
        if tag == "table" and self.depth:
            self.depth -= 1
        elif tag in ("td", "th") and self.cell is not None:
            self.row.append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "tr" and self.row is not None:
            self.rows.append((self.table, self.heading.strip(), self.row))
            self.row = None
        elif tag in ("h1", "h2", "h3", "h4", "caption"):
            self.in_heading = False

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)
        elif self.in_heading:
            self.heading += data


def tables(pages: DataFrame, html: str, key: str, css_class: str | None = None) -> DataFrame:
    """(key, table, heading, row, cells): every row of every table of a page."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, text in zip(b[key], b[html]):
                p = _Tables(css_class)
                p.feed(text or "")
                out += [(k, t, h, i, cells) for i, (t, h, cells) in enumerate(p.rows)]
            yield pd.DataFrame(out, columns=[key, "table", "heading", "row", "cells"])

    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, table int, heading string, row int, cells array<string>")


def constituents(pages: DataFrame, html: str, key: str, least: int = 400, most: int = 600) -> DataFrame:
    """(symbol, name, sector, cik) of a page's first table, by its header's names; a count outside the bounds or a symbol twice fails."""
    t = tables(pages, html, key, "wikitable").filter("table = 0")
    head = F.transform(F.min_by("cells", "row").over(W.partitionBy(key)), lambda c: F.lower(c))
    t = t.withColumn("head", head)
    at = lambda name: F.get("cells", F.array_position("head", F.lit(name)).cast("int") - 1)
    rows = t.filter(F.transform("cells", lambda c: F.lower(c)) != F.col("head")).select(F.upper(F.translate(at("symbol"), "-", ".")).alias("symbol"), at("security").alias("name"), at("gics sector").alias("sector"), F.lpad(at("cik"), 10, "0").alias("cik"))
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("symbol").alias("d")).first()
    if not least <= n["n"] <= most:
        raise ValueError(f"{n['n']} constituents; expected {least} to {most}")
    if n["n"] != n["d"]:
        raise ValueError("a symbol occurs twice")
    return rows


def release_dates(pages: DataFrame, html: str, key: str, kind: str, minute: int = 510, least: int = 1, most: int = 400) -> DataFrame:
    """(kind, scheduled_at) from tables with cells like 'January 15, 2026', 'Jan. 15' or 'January 27-28'.

    A year that the cell lacks comes from the heading above; of a range the last
    day counts. The time of day is New York's. Too few or too many dates fail.
    """
    pattern = r"(?i)\b([a-z]{3,9})\.?\s+(?:\d{1,2}\s*[-–]\s*)?(\d{1,2})(?:,?\s+(\d{4}))?\b"
    cell = tables(pages, html, key).withColumn("c", F.explode("cells")).filter(F.col("c").rlike(pattern))
    short = F.create_map(*[x for m, i in MONTHS.items() for x in (F.lit(m[:3]), F.lit(i))])
    month = F.try_element_at(short, F.lower(F.substring(F.regexp_extract("c", pattern, 1), 1, 3)))
    year = F.coalesce(F.nullif(F.regexp_extract("c", pattern, 3), F.lit("")), F.nullif(F.regexp_extract("heading", r"\b(20\d\d)\b", 1), F.lit("")))
    at = dates.wall_clock(year.cast("int"), month, F.regexp_extract("c", pattern, 2).cast("int"), F.lit(minute // 60), F.lit(minute % 60))
    out = cell.select(F.lit(kind).alias("kind"), at.alias("scheduled_at")).filter("scheduled_at IS NOT NULL").distinct()
    n = out.count()
    if not least <= n <= most:
        raise ValueError(f"{n} {kind} dates; expected {least} to {most}")
    return out
