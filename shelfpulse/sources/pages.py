"""Date / name extraction from HTML pages held in a DataFrame column.

Fetching pages over HTTP is not part of the library; the input is any DataFrame with an HTML
string column, one page per row, so pages spread over all tasks.  ``table_rows`` and
``day_names`` are table functions over Arrow batches: each page runs through the standard
library's tag events once, and its rows go on as columns.

Rules of the markup.  Entities are decoded, script, style and comments are no text, the text
pieces of an element are joined by a blank and white space is collapsed.  A cell's text holds
all that is inside it, nested tables included; rows and cells belong to the innermost table, and
a nested table is a table of its own.  A start tag of td, th, tr or li ends an open one of its
kind in the same table or list; what is open at the end of the page ends there.  Rows with fewer
cells than asked for are skipped, like days that are no dates.  NULL pages give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAG = "<[^>]+>"
# fixed values: elements without an end tag, and what a start tag ends up to which barrier
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
IMPLIED = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "tbody": ("thead", "tbody"), "tfoot": ("tbody",), "li": ("li",)}
BARRIERS = {"td": "table", "th": "table", "tr": "table", "tbody": "table", "thead": "table", "tfoot": "table", "li": "list"}
LISTS = ("ul", "ol")


class Element:
    __slots__ = ("tag", "attrs", "texts")

    def __init__(self, tag: str, attrs: dict, texts: list | None = None):
        self.tag, self.attrs, self.texts = tag, attrs, texts

    def text(self) -> str:
        return " ".join(" ".join(self.texts).split())


class Markup(HTMLParser):
    """Open elements of a page; subclasses say which collect text and what they give."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[Element] = []
        self.collecting: list[Element] = []
        self.found: list[tuple] = []

    def begin(self, e: Element) -> bool:
        """Does this element collect text?"""
        return False

    def end(self, e: Element) -> None:
        """An element that ended."""

    def _last(self, tags: tuple[str, ...], barrier: str | None) -> int | None:
        for i in range(len(self.open) - 1, -1, -1):
            tag = self.open[i].tag
            if tag in tags:
                return i
            if barrier == "table" and tag == "table" or barrier == "list" and tag in LISTS:
                return None
        return None

    def _close_from(self, i: int) -> None:
        while len(self.open) > i:
            e = self.open.pop()
            if e.texts is not None:
                self.collecting.pop()
            self.end(e)

    def handle_starttag(self, tag, attrs):
        at = self._last(IMPLIED[tag], BARRIERS[tag]) if tag in IMPLIED else None
        if at is not None:
            self._close_from(at)
        if tag in VOID:
            return
        e = Element(tag, dict(attrs))
        self.open.append(e)
        if self.begin(e):
            e.texts = []
            self.collecting.append(e)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        at = self._last((tag,), BARRIERS.get(tag))
        if at is not None:
            self._close_from(at)

    def handle_data(self, data):
        if self.collecting and self.open[-1].tag not in ("script", "style"):
            for e in self.collecting:
                e.texts.append(data)

    def read(self, html: str) -> list[tuple]:
        self.feed(html)
        self.close()
        self._close_from(0)
        return self.found


class TableRows(Markup):
    """(table, row, header, cells) of every body row; header is the first th of the thead."""

    def __init__(self):
        super().__init__()
        self.tables: list[dict] = []
        self.seen = 0

    def begin(self, e):
        if e.tag == "table":
            self.tables.append({"no": self.seen, "part": None, "header": None, "rows": [], "cells": None})
            self.seen += 1
            return False
        if not self.tables:
            return False
        t = self.tables[-1]
        if e.tag in ("thead", "tbody", "tfoot"):
            t["part"] = e.tag
        elif e.tag == "tr" and t["part"] == "tbody":
            t["cells"] = []
        return e.tag == "td" and t["cells"] is not None or e.tag == "th" and t["part"] == "thead" and t["header"] is None

    def end(self, e):
        if not self.tables:
            return
        t = self.tables[-1]
        if e.texts is not None and e.tag == "td":
            t["cells"].append(e.text())
        elif e.texts is not None and t["header"] is None:
            t["header"] = e.text()
        elif e.tag == "tr" and t["cells"] is not None:
            t["rows"].append(t["cells"])
            t["cells"] = None
        elif e.tag == t["part"]:
            t["part"] = None
        elif e.tag == "table":
            self.tables.pop()
            self.found += [(t["no"], i, t["header"], cells) for i, cells in enumerate(t["rows"])]


class DayNames(Markup):
    """(data-date, name) of every div whose class ends with Cal in a td of class single-day."""

    def __init__(self):
        super().__init__()
        self.days: list[str] = []

    @staticmethod
    def _day(e: Element) -> str | None:
        return e.attrs.get("data-date") if e.tag == "td" and "single-day" in (e.attrs.get("class") or "").split() else None

    def begin(self, e):
        if self._day(e):
            self.days.append(self._day(e))
        return e.tag == "div" and bool(self.days) and any(c.endswith("Cal") for c in (e.attrs.get("class") or "").split())

    def end(self, e):
        if e.texts is not None:
            self.found.append((self.days[-1], e.text()))
        elif self._day(e):
            self.days.pop()


def _read_pages(pages: DataFrame, html_col: str, keep: list[str], machine: type[Markup], fields: list[T.StructField],
                kinds: list[pa.DataType]) -> DataFrame:
    """The rows a machine finds in every page, beside the page's ``keep`` columns."""
    names = [f.name for f in fields]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for start in range(0, whole.num_rows, 64):       # few pages are Python objects at a time
                batch = whole.slice(start, 64)
                at, found = [], []
                for i, html in enumerate(batch.column(0).to_pylist()):
                    rows = machine().read(html) if html else []
                    at += [i] * len(rows)
                    found += rows
                cols = list(zip(*found)) if found else [()] * len(kinds)
                kept = [c.take(pa.array(at, pa.int32())) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, k) for c, k in zip(cols, kinds))], [*keep, *names])

    schema = T.StructType([pages.schema[c] for c in keep] + fields)
    return pages.select(F.col(html_col), *keep).mapInArrow(run, schema)


def table_rows(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """One row per row in a table's tbody: ``keep`` columns, table_no, row_no, header, cells."""
    fields = [T.StructField("table_no", T.IntegerType()), T.StructField("row_no", T.IntegerType()),
              T.StructField("header", T.StringType()), T.StructField("cells", T.ArrayType(T.StringType()))]
    return _read_pages(pages, html_col, list(keep or []), TableRows, fields,
                       [pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string())])


def day_names(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """One row per named day: ``keep`` columns, day (as the page has it), name."""
    fields = [T.StructField("day", T.StringType()), T.StructField("name", T.StringType())]
    return _read_pages(pages, html_col, list(keep or []), DayNames, fields, [pa.string(), pa.string()])


def extract_table_rows(pages: DataFrame, year: int, month: int | None = None,
                       html_col: str = "html", keep: list[str] | None = None, ordered: bool = True) -> DataFrame:
    """(date, name) rows from month tables (A8), beside the ``keep`` columns of their page.

    The month is the first word of the table's header, the day the first word of a body row's
    first cell, the name its second cell; days that are no dates are skipped.  ``month`` (1-12,
    anything else raises) keeps one.  ``ordered`` sorts by date and name; without it no rows
    move between tasks.
    """
    if month is not None and not 1 <= int(month) <= 12:
        raise ValueError(f"month must be 1-12, got {month}")
    keep = list(keep or [])
    rows = table_rows(pages, html_col, keep).where(F.size("cells") >= 2)
    word = lambda c: F.regexp_extract(c, r"^(\S+)", 1)
    date = F.try_to_date(F.concat_ws(" ", word(F.get("cells", F.lit(0))), word(F.col("header")), F.lit(str(year))), "d MMMM yyyy")
    out = rows.select(*keep, date.alias("date"), F.get("cells", F.lit(1)).alias("name")).where(F.col("date").isNotNull())
    if month is not None:
        out = out.where(F.month("date") == int(month))
    return out.orderBy("date", "name") if ordered else out


def extract_day_cells(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """(date, name) of calendar day cells (A9), beside the ``keep`` columns: every
    ``div[class$=Cal]`` with text in a ``td.single-day[data-date]``; other dates than
    yyyy-MM-dd are skipped."""
    keep = list(keep or [])
    out = day_names(pages, html_col, keep).select(*keep, F.try_to_date("day", "yyyy-MM-dd").alias("date"), "name")
    return out.where(F.col("date").isNotNull() & (F.col("name") != ""))


def _text(c):
    """Inner text: tags removed, whitespace collapsed, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, TAG, " "), r"\s+", " "))


def extract_list_items(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Every ``<li>`` of every page with its position and inner text (A8 on list markup)."""
    items = pages.select(id_col, F.posexplode(
        F.regexp_extract_all(F.col(html_col), F.lit(r"(?s)<li[^>]*>(.*?)</li>"), 1)).alias("pos", "li"))
    return items.select(id_col, F.col("pos").cast("bigint").alias("pos"), _text("li").alias("item"))
