"""HTML to text and to table cells."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quire.plans import arrow

#: Elements that end a line, and elements without text.
BLOCKS = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "section", "article", "header", "footer", "nav", "main", "blockquote", "pre", "title", "hr", "dt", "dd"}
SILENT = {"script", "style", "noscript", "template", "head", "title"}


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.silent, self.links = [], 0, []

    def handle_starttag(self, tag, attrs):
        self.silent += tag in SILENT
        if tag == "body":  # a head that isn't closed ends here
            self.silent = 0
        if tag in BLOCKS:
            self.out.append("\n")
        if tag == "a":
            self.links += [v for k, v in attrs if k == "href" and v]

    def handle_endtag(self, tag):
        self.silent -= tag in SILENT and self.silent > 0
        if tag in BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.silent:
            self.out.append(data)


def text_and_links(html: str) -> tuple[str, list[str]]:
    """Text with a line per block, at most one blank line in a row, and the links' targets."""
    p = _Text()
    p.feed(html)
    p.close()
    lines, blank = [], True
    for line in (" ".join(x.split()) for x in "".join(p.out).split("\n")):
        if line or not blank:
            lines.append(line)
        blank = not line
    return "\n".join(lines).strip("\n"), p.links


def html_to_text(html: Column | str) -> Column:
    """struct(text string, links array<string>) of a page; null counts as empty."""

    @F.pandas_udf("text string, links array<string>")
    def run(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_and_links(h or "") for h in pages], columns=["text", "links"])

    return run(html)


class _Cells(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables, self.cell = [], None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            number = lambda k: max(1, int(a.get(k) or 1)) if str(a.get(k) or 1).isdigit() else 1
            self.cell = [number("rowspan"), number("colspan"), ""]
            self.tables[-1][-1].append(self.cell)

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr"):
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell[2] += data


#: One table of cells without spans or inner elements.
_PLAIN = re.compile(r"<table>\s*(?:<tr>(?:<td>[^<]*</td>)*</tr>\s*)*</table>\s*")
_CELL = re.compile(r"<td>([^<]*)</td>")


def table_cells(html: str) -> list[tuple[int, int, int, int, int, str]]:
    """(table, row, col, row span, col span, text) with slots that spans take skipped."""
    if _PLAIN.fullmatch(html):
        rows = html.split("<tr>")[1:]
        return [(0, r, c, 1, 1, " ".join((unescape(t) if "&" in t else t).split())) for r, row in enumerate(rows) for c, t in enumerate(_CELL.findall(row))]
    p = _Cells()
    p.feed(html)
    out = []
    for t, rows in enumerate(p.tables):
        taken: set[tuple[int, int]] = set()
        for r, row in enumerate(rows):
            c = 0
            for rs, cs, text in row:
                while (r, c) in taken:
                    c += 1
                taken |= {(r + i, c + j) for i in range(rs) for j in range(cs)}
                out.append((t, r, c, rs, cs, " ".join(text.split())))
                c += cs
    return out


def html_table_cells(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    schema = StructType.fromDDL("id long, table_no int, row int, col int, row_span int, col_span int, text string")
    kinds = to_arrow_schema(schema)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [(i, table_cells(h)) for i, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if h]
        cells = list(zip(*(c for _, t in found for c in t), strict=True))
        if cells:
            ids = np.repeat(np.array([i if i is not None else 0 for i, _ in found], np.int64), [len(t) for _, t in found])
            known = np.repeat([i is not None for i, _ in found], [len(t) for _, t in found])
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~known), *(pa.array(c, f.type) for c, f in zip(cells, list(kinds)[1:], strict=True))], schema=kinds)

    return arrow.mapped(pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html")), run, schema)
