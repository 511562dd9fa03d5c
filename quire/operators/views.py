"""Text projections of numbered lines: one row per page and option."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import dehyphenate, html_escape, json_number
from quire.plans import arrow, virtual


def _ordered(value: Column, *order: str) -> Column:
    """Strings of a group in order, joined without a separator."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, value.alias("_v")))), lambda s: s["_v"]), "")


def _pages(docs: DataFrame, line: Column, block) -> DataFrame:
    """``line`` strings joined by block, passed through ``block`` and joined by page."""
    rows = virtual.numbered_lines(docs).groupBy("doc_id", "page_no", "block_no").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), _ordered(line, "line_no").alias("v"))
    return rows.groupBy("doc_id", "page_no").agg(_ordered(block(F.col("v")), "block_no").alias("out"))


def text(docs: DataFrame, dehyphenated: bool = False) -> DataFrame:
    """Lines end in a line feed, and so a page of text does."""
    page = F.array_join(F.transform("ls", lambda s: F.concat(s["text"], F.lit("\n"))), "")
    out = virtual.pages(docs).select("doc_id", "page_no", page.alias("out"))
    return out.withColumn("out", dehyphenate(F.col("out"))) if dehyphenated else out


def whole_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text, whole): each text with the texts of its pages one after the other; a
    text without ink has no row, as it has no page."""

    def make(y: virtual.Layout):
        y.number()
        k = y.inked
        size = y.b1[k] - y.b0[k] + 1
        ends = np.cumsum(size)
        data = np.full(size.sum(), 10, np.uint8)
        inner = np.ones(len(data), bool)
        inner[ends - 1] = False
        data[inner] = y.data[arrow.ranges(y.b0[k], size - 1)]
        first = np.flatnonzero(np.diff(y.doc[k], prepend=-1))
        return y.doc[k][first], {"whole": arrow.strings(data, np.append((ends - size)[first], len(data)))}

    return virtual.laid_out(docs, "whole string", make, kept=("doc_id", "text"))


def html(docs: DataFrame) -> DataFrame:
    line = F.concat(F.lit('<p style="top:'), json_number(F.col("y0")), F.lit("pt;left:"), json_number(F.col("x0")), F.lit('pt"><span>'), html_escape(F.col("text")), F.lit("</span></p>\n"))
    return _pages(docs, line, lambda v: v).withColumn("out", F.concat(F.lit('<div style="width:612pt;height:792pt">\n'), "out", F.lit("</div>\n")))


def xhtml(docs: DataFrame) -> DataFrame:
    return _pages(docs, F.concat(html_escape(F.col("text")), F.lit("\n")), lambda v: F.concat(F.lit("<p>"), v, F.lit("</p>\n"))).withColumn("out", F.concat(F.lit("<div>\n"), "out", F.lit("</div>\n")))


def xml(docs: DataFrame) -> DataFrame:
    box = F.concat_ws(" ", *(json_number(F.col(c)) for c in ("x0", "y0", "x1", "y1")))
    line = F.concat(F.lit('<line bbox="'), box, F.lit('">'), html_escape(F.col("text")), F.lit("</line>\n"))
    return _pages(docs, line, lambda v: F.concat(F.lit('<block bbox="'), box, F.lit('">\n'), v, F.lit("</block>\n"))).withColumn("out", F.concat(F.lit('<page width="612" height="792">\n'), "out", F.lit("</page>\n")))


def json(docs: DataFrame) -> DataFrame:
    """Nested blocks, lines and spans as one JSON text."""
    box = F.concat(F.lit("["), F.concat_ws(",", *(json_number(F.col(c)) for c in ("x0", "y0", "x1", "y1"))), F.lit("]"))
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.col("text"), r'(["\\])', r"\\$1"), F.lit('"'))
    line = F.concat(F.when(F.col("line_no") > 0, ",").otherwise(""), F.lit('{"bbox":'), box, F.lit(',"spans":[{"size":11,"font":"Courier","text":'), quoted, F.lit("}]}"))
    block = lambda v: F.concat(F.when(F.col("block_no") > 0, ",").otherwise(""), F.lit('{"number":'), F.col("block_no"), F.lit(',"type":0,"bbox":'), box, F.lit(',"lines":['), v, F.lit("]}"))
    return _pages(docs, line, block).withColumn("out", F.concat(F.lit('{"width":612,"height":792,"blocks":['), "out", F.lit("]}")))


RAWDICT = "array<struct<block_no:int,lines:array<struct<line_no:int,chars:array<struct<char_no:int,c:string,x0:double,y0:double,x1:double,y1:double>>>>>>"


def _rawdict(y: virtual.Layout) -> tuple[np.ndarray, dict]:
    _, count, chars = virtual.inked_chars(y)
    k, page, block = y.inked, np.flatnonzero(y.new_page), np.flatnonzero(y.new_block)
    in_line = arrow.lists(np.append(0, np.cumsum(count)), arrow.structs(chars))
    in_block = arrow.lists(np.append(block, len(k)), arrow.structs({"line_no": y.line_no[k].astype(np.int32), "chars": in_line}))
    in_page = np.searchsorted(block, np.append(page, len(k)))
    blocks = arrow.lists(in_page, arrow.structs({"block_no": y.block_no[k][block].astype(np.int32), "lines": in_block}))
    return y.doc[k][page], {"page_no": y.page[k][page].astype(np.int32), "blocks": blocks}


def rawdict(docs: DataFrame) -> DataFrame:
    """Nested blocks, lines and characters as arrays of structs."""
    return virtual.laid_out(docs, f"page_no int, blocks {RAWDICT}", _rawdict, virtual.PART_BYTES // 4)


def rawdict_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, page_no, n_blocks, n_lines, n_chars, text): what the arrays of ``rawdict``
    hold, counted and read where they are made, as a character takes some 50 bytes there."""

    def make(y: virtual.Layout):
        at, out = _rawdict(y)
        places = [out["blocks"].offsets.to_numpy()]
        lines = out["blocks"].values.field("lines")
        places.append(lines.offsets.to_numpy()[places[-1]])
        chars = lines.values.field("chars")
        places.append(chars.offsets.to_numpy()[places[-1]])
        data, ends = arrow.string_parts(chars.values.field("c"))
        counts = {n: np.diff(p).astype(np.int64) for n, p in zip(("n_blocks", "n_lines", "n_chars"), places, strict=True)}
        return at, {"page_no": out["page_no"], **counts, "text": arrow.strings(data, ends[places[-1]])}

    return virtual.laid_out(docs, "page_no int, n_blocks long, n_lines long, n_chars long, text string", make, virtual.PART_BYTES // 4)


def texttrace(docs: DataFrame) -> DataFrame:
    """A record per line and span in paint order, with colour, direction and its length."""
    rows = virtual.pages(docs).select("doc_id", "page_no", F.posexplode("ls").alias("seqno", "l"))
    return rows.select("doc_id", "page_no", "seqno", F.lit(0).alias("color"), F.lit(1.0).alias("dir_x"), F.lit(0.0).alias("dir_y"), F.lit(virtual.SIZE).alias("size"), F.char_length("l.text").alias("n_chars"), "l.x0", "l.y0", "l.x1", "l.y1")


def bboxlog(docs: DataFrame) -> DataFrame:
    return texttrace(docs).select("doc_id", "page_no", "seqno", F.lit("fill-text").alias("kind"), "x0", "y0", "x1", "y1")


VIEWS = {"text": text, "html": html, "xhtml": xhtml, "xml": xml, "json": json}


def get_text(docs: DataFrame, option: str = "text") -> DataFrame:
    """(doc_id, page_no, out) of a text option, or the words or blocks relation; an unknown
    option gives plain text."""
    if option == "words":
        return virtual.words(docs)
    if option == "blocks":
        return virtual.blocks(docs)
    return VIEWS.get(option, text)(docs)


def sorted_by_position(rows: DataFrame, *ties: str) -> DataFrame:
    """Words or blocks with ``ord``, their place on their page from top to bottom and then
    from left to right; rows in one place follow each other in the order of ``ties``."""
    place = Window.partitionBy("doc_id", "page_no").orderBy("y0", "x0", *ties)
    return rows.withColumn("ord", F.row_number().over(place))


def sorted_words(docs: DataFrame) -> DataFrame:
    """(doc_id, page_no, word, ord): the words of virtual pages in their places, as
    ``sorted_by_position`` gives them; a text is sorted where it is laid out."""

    def make(y: virtual.Layout):
        y.number()
        k = y.of
        page = np.cumsum(y.new_page)[np.searchsorted(y.inked, k)] if len(k) else k
        x0 = y.x(y.chars[y.w0] - y.c0[k])
        order = np.lexsort((y.word_no, y.line_no[k], y.block_no[k], x0, y.y0(y.row[k]), page))
        page, k = page[order], k[order]
        first = np.flatnonzero(np.diff(page, prepend=-1))
        ord_ = np.arange(1, len(page) + 1) - np.repeat(first, np.diff(np.append(first, len(page))))
        word = arrow.strings(y.data[y.ink], np.append(0, np.cumsum(y.w1 - y.w0))).take(order)
        return y.doc[k], {"page_no": y.page[k].astype(np.int32), "word": word, "ord": ord_.astype(np.int64)}

    return virtual.laid_out(docs, "page_no int, word string, ord long", make)
