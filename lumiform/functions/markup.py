"""Depth-aware HTML, which regular expressions of SQL can't follow: nested tables and spans, and slices by byte offsets.

The plain functions work on one string; the pandas UDFs below wrap them for batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

INFOBOX = re.compile(rb"<table\b[^>]*\bclass\s*=\s*[\"'][^\"']*\binfobox\b", re.I)
TABLE = re.compile(rb"<(/?)table\b[^>]*>", re.I)
TABLE_TEXT = re.compile(r"<(/?)table\b[^>]*>", re.I)
SPAN = re.compile(r"<(/?)span\b[^>]*>", re.I)
#: opening tags of spans that a reader doesn't see
HIDDEN = r'<span\b[^>]*(?:class="[^"]*noprint[^"]*"|style="[^"]*display:\s*none[^"]*")[^>]*>'


def closed(tags, text) -> list[tuple[int, int, int, int]]:
    """start, end of the opening tag, end of the closing tag, depth outside of every element that is closed, by one pass with a stack; a closing tag without
    an opening one counts for nothing."""
    out, open_ = [], []
    for t in tags.finditer(text):
        if not t[1]:
            open_.append((t.start(), t.end()))
        elif open_:
            out.append((*open_.pop(), t.end(), len(open_)))
    return sorted(out)


def infobox_ranges(html: bytes) -> list[tuple[int, int]]:
    """Byte ranges (end exclusive) of the infobox tables in page order, those inside others too; one that is never closed has none."""
    return [(start, end) for start, _, end, _ in closed(TABLE, html) if INFOBOX.match(html, start)]


def without(text: str, ranges: list[tuple[int, int]], instead: str = "") -> str:
    """text with `instead` for each range; a range inside one before it goes with that."""
    out, at = [], 0
    for start, end in ranges:
        if start >= at:
            out += [text[at:start], instead]
            at = end
    return "".join(out) + text[at:]


def without_nested_tables(html: str) -> str:
    """html with a space for every closed table that stands inside another; tables that are never closed stay."""
    return without(html, [(start, end) for start, _, end, depth in closed(TABLE_TEXT, html) if depth], " ")


def without_spans(html: str, opening: str) -> str:
    """html without the spans whose opening tag matches, with the spans inside them; one that is never closed loses its opening tag alone."""
    ends = {start: end for start, _, end, _ in closed(SPAN, html)}
    return without(html, [(m.start(), ends.get(m.start(), m.end())) for m in re.finditer(opening, html, re.I)])


def find_ranges(html: Column) -> Column:
    """infobox_ranges as an array of (start, stop)."""

    def run(h: pd.Series) -> pd.Series:
        return h.map(lambda x: [{"start": a, "stop": b} for a, b in infobox_ranges((x or "").encode())])

    return F.pandas_udf(run, "array<struct<start:bigint,stop:bigint>>")(html)


def flat_table(html: Column) -> Column:
    def run(h: pd.Series) -> pd.Series:
        return h.map(lambda x: None if x is None else without_nested_tables(x))

    return F.pandas_udf(run, "string")(html)


def strip_spans(html: Column, opening: str) -> Column:
    def run(h: pd.Series) -> pd.Series:
        return h.map(lambda x: None if x is None else without_spans(x, opening))

    return F.pandas_udf(run, "string")(html)


def inside_any(start: Column, stop: Column, ranges: Column) -> Column:
    """Whether a span lies in one of the ranges: a range join without a shuffle, as a page's ranges are few."""
    return F.coalesce(F.exists(ranges, lambda r: (start >= r["start"]) & (stop <= r["stop"])), F.lit(False))


def byte_slice(text: Column, start: Column, stop: Column) -> Column:
    """A slice by byte offsets of the UTF-8 text."""
    return F.decode(F.substring(F.encode(text, "UTF-8"), start.cast("int") + 1, (stop - start).cast("int")), "UTF-8")


def match_example(html: Column, start: Column, stop: Column) -> Column:
    """What a question's raw record keeps: the answer's bytes and the page behind them; null unless the answer lies in an infobox."""
    size = F.octet_length(html).cast("bigint")
    return F.when((start >= 0) & inside_any(start, stop, find_ranges(html)), F.struct(byte_slice(html, start, stop).alias("infobox"), byte_slice(html, stop, size).alias("rest")))
