"""Fetched news pages to incident rows."""

from __future__ import annotations

from html import unescape
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from incidentry.functions.text import day_of, month_number, squeeze, strip, summary_text

# Where the page holds an incident and its date, as (tag, attribute, value).
ITEM = ("div", "class", "more")
DATE = ("td", "style", "width: 15%;")
#: Pages of a batch whose texts are held as Python strings at once.
PAGES_AT_ONCE = 100


class _Finder(HTMLParser):
    """Texts of the elements that a selector names, nested ones included, in page order."""

    def __init__(self, selectors: list[tuple[str, str, str]]):
        super().__init__(convert_charrefs=True)
        self.selectors = selectors
        self.found: list[list[list[str]]] = [[] for _ in selectors]
        self.open: list[tuple[str, list[str] | None]] = []
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        self.silent += tag in ("script", "style")
        named = dict(attrs)
        for at, (wanted, name, value) in enumerate(self.selectors):
            if tag == wanted:
                given = named.get(name) or ""
                hit = value in given.split() if name == "class" else given == value
                parts = [] if hit else None
                if hit:
                    self.found[at].append(parts)
                self.open.append((tag, parts))

    def handle_endtag(self, tag):
        self.silent -= tag in ("script", "style") and self.silent > 0
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        if not self.silent:
            for _, parts in self.open:
                if parts is not None:
                    parts.append(data)

    def texts(self) -> list[list[str]]:
        return [["".join(parts).replace("\xa0", " ") for parts in each] for each in self.found]


def element_arrays(pages: pa.Array, selectors: list[tuple[str, str, str]], kind: pa.StructType) -> pa.Array:
    """What :func:`element_texts` gives for one batch; few pages at once are more than Arrow buffers."""
    made = [pa.array([], kind)]
    for at in range(0, len(pages), PAGES_AT_ONCE):
        rows = []
        for page in pages.slice(at, PAGES_AT_ONCE).to_pylist():
            finder = _Finder(selectors)
            finder.feed(page or "")
            finder.close()
            rows.append({f"t{k}": texts for k, texts in enumerate(finder.texts())})
        made.append(pa.array(rows, kind))
    return pa.concat_arrays(made)


def element_texts(html: Column, selectors: list[tuple[str, str, str]]) -> Column:
    """Per page a struct of arrays ``t0, t1, ...``: the texts of the elements of each selector, entities decoded."""

    kind = pa.struct([(f"t{k}", pa.list_(pa.string())) for k in range(len(selectors))])

    @F.arrow_udf(", ".join(f"t{k} array<string>" for k in range(len(selectors))))
    def parse(pages: pa.Array) -> pa.Array:
        return element_arrays(pages, selectors, kind)

    return parse(html)


def fragments(html: Column, pattern: str) -> Column:
    """Inner HTML of every element a pattern finds, in page order."""
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(1))


@F.pandas_udf(ArrayType(StringType()))
def decoded(parts: pd.Series) -> pd.Series:
    """Every character reference of the texts decoded."""
    return parts.map(lambda p: None if p is None else [unescape(x).replace("\xa0", " ") for x in p])


def page_items(pages: DataFrame, item: tuple | str = ITEM, date: tuple | str = DATE) -> DataFrame:
    """Pages with ``items`` and ``dates`` as plain text; pages whose numbers differ are dropped.

    Both are selectors of elements, parsed in one pass, or both are patterns of fragments.
    """
    if isinstance(item, str):
        def texts(pattern: str) -> Column:
            bare = F.transform(fragments(F.col("html"), pattern), lambda x: F.regexp_replace(x, r"(?s)<!--.*?-->|<[^>]*>", ""))
            return decoded(bare)

        found = pages.withColumns({"_i": texts(item), "_d": texts(date)}).drop("html")
    else:
        found = pages.withColumn("_t", element_texts(F.col("html"), [item, date])).drop("html")
        found = found.withColumns({"_i": F.col("_t.t0"), "_d": F.col("_t.t1")}).drop("_t")
    kept = found.filter(F.size("_i") == F.size("_d"))
    return kept.withColumns({
        "items": F.transform("_i", summary_text), "dates": F.transform("_d", lambda x: squeeze(strip(x))),
    }).drop("_i", "_d")


def numbered_incidents(pages: DataFrame) -> DataFrame:
    """One row per incident of (series, year, month, items, dates) pages.

    Incident_Number is I, month, day, two-digit year, and a running number per date
    within the page, in page order. The number depends on the page alone, so a page
    read again gives the same numbers; there is no shuffle.
    """
    month = month_number(F.col("month"))
    days = F.transform("dates", day_of)
    numbers = F.transform(
        "_days", lambda d, i: F.size(F.filter(F.slice("_days", 1, i + 1), lambda x: x == d)))
    return (
        pages.withColumns({"_month": month, "_days": days})
        .filter(F.col("_month").isNotNull() & (F.size("_days") > 0))
        .withColumn("_n", numbers)
        .select("series", "year", "_month", F.inline(F.arrays_zip("items", "_days", "_n")))
        .select(
            F.concat(
                F.lit("I"), "_month", "_days", F.substring("year", -2, 2),
                F.when(F.length(F.col("_n").cast("string")) >= 2, F.col("_n").cast("string")).otherwise(
                    F.lpad(F.col("_n").cast("string"), 2, "0"))).alias("Incident_Number"),
            F.concat_ws("-", "year", "_month", "_days").alias("Date"),
            F.col("items").alias("Incident_Summary"),
            F.col("series").alias("Series"),
        )
        .withColumn("Incident_ID", F.concat_ws("_", "Series", "Incident_Number"))
    )


def incidents(pages: DataFrame, item: tuple | str = ITEM, date: tuple | str = DATE) -> DataFrame:
    """Incident rows of a page table (series, year, month, html), batch or stream."""
    return numbered_incidents(page_items(pages, item, date))
