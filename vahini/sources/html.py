"""Tables, caption-value pairs and links out of landed HTML pages (no HTML parser is built into Spark)."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType


class _Rows(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.links: list[tuple[str, str]] = []
        self.cell: list[str] | None = None
        self.href: str | None = None
        self.text: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self._end_cell()
            self.cell = []
        elif tag == "a":
            self.href, self.text = dict(attrs).get("href"), []

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr"):
            self._end_cell()
        elif tag == "a" and self.href is not None:
            self.links.append((" ".join("".join(self.text).split()), self.href))
            self.href = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)
        if self.href is not None:
            self.text.append(data)

    def _end_cell(self):
        if self.cell is not None:
            self.rows[-1].append(" ".join("".join(self.cell).split()))
            self.cell = None


def _parse(page: str | None) -> _Rows:
    p = _Rows()
    if isinstance(page, str):
        p.feed(page)
        p.close()
    return p


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def table_rows(page: pd.Series) -> pd.Series:
    """Rows of cells of all tables of a page; pages without tables, NULL and empty pages have none."""
    return page.map(lambda x: [r for r in _parse(x).rows if r])


@F.pandas_udf(ArrayType(StructType([StructField("text", StringType()), StructField("href", StringType())])))
def page_links(page: pd.Series) -> pd.Series:
    return page.map(lambda x: [{"text": t, "href": h} for t, h in _parse(x).links])


def listing(pages: DataFrame, html: str, cells: int, number_first: bool = True) -> DataFrame:
    """Table rows with at least so many cells (and a number in the first) as ``cells`` of each page; other rows are left out."""
    rows = pages.withColumn("cells", F.explode(table_rows(html))).filter(F.size("cells") >= cells)
    return rows.filter(F.col("cells")[0].rlike(r"^\d+\.?$")) if number_first else rows


def captions(rows: Column) -> Column:
    """Rows of two or more cells as a map from caption to value, the first of equal captions wins, colons at the end don't count."""
    key = lambda r: F.regexp_replace(F.trim(r[0]), r"\s*:+$", "")
    pairs = F.transform(F.filter(rows, lambda r: (F.size(r) >= 2) & (F.trim(r[0]) != "")), lambda r: F.struct(key(r).alias("k"), r[1].alias("v")))
    first = F.aggregate(
        pairs, F.expr("CAST(map() AS MAP<STRING, STRING>)"), lambda m, p: F.when(F.map_contains_key(m, p["k"]), m).otherwise(F.map_concat(m, F.create_map(p["k"], p["v"])))
    )
    return first


def bidders(rows: Column) -> Column:
    """Bidder rows (name, status, value) under a header row that names them; texts over 120 characters are no names."""
    low = lambda r: F.transform(r, F.lower)
    header = F.filter(rows, lambda r: F.exists(low(r), lambda c: c.contains("bidder")) & F.exists(low(r), lambda c: c.contains("value") | c.contains("amount") | c.contains("status")))[0]
    at = lambda word: F.array_position(F.transform(header, lambda c: F.lower(c).contains(word)), True).cast("int")
    name, status, value = at("bidder"), at("status"), F.greatest(at("value"), at("amount"))
    get = lambda r, i: F.when(i > 0, F.try_element_at(r, i))
    listed = F.filter(rows, lambda r: (F.size(r) >= F.size(header)) & (r != header) & (F.length(get(r, name)) > 0) & (F.length(get(r, name)) <= 120))
    return F.when(
        header.isNotNull(), F.transform(listed, lambda r: F.struct(get(r, name).alias("name"), get(r, status).alias("status"), get(r, value).alias("value")))
    )


def file_links(pages: DataFrame, column: str, kinds: str = "pdf|zip|xlsx?|docx?") -> DataFrame:
    """Links to files by their ending, as ``name`` and ``href`` beside the columns of each page."""
    links = pages.withColumn("link_", F.explode(page_links(column))).filter(F.col("link_.href").rlike(rf"(?i)\.({kinds})$"))
    return links.select("*", F.col("link_.text").alias("name"), F.col("link_.href").alias("href")).drop("link_")
