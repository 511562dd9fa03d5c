"""Filters by area: text in boxes, words and blocks in clips, selections, searches."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.geometry import Rect
from quire.plans import virtual


def words_in(docs: DataFrame, clip: Rect) -> DataFrame:
    return virtual.words(docs).filter(Rect.named().intersects(clip))


def blocks_in(docs: DataFrame, clip: Rect) -> DataFrame:
    return virtual.blocks(docs).filter(Rect.named().intersects(clip))


def _joined(rows: DataFrame, value: str, order: list[str], by: list[str], sep: str, out: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))), lambda s: s["_v"]), sep).alias(out))


def textbox_chars(docs: DataFrame, clip: Rect) -> DataFrame:
    """(doc_id, page_no, text): characters that strictly overlap the clip, by line."""
    rows = virtual.chars(docs).filter(Rect.named().intersects(clip))
    by_line = _joined(rows, "c", ["char_no"], ["doc_id", "page_no", "block_no", "line_no"], "", "line")
    return _joined(by_line, "line", ["block_no", "line_no"], ["doc_id", "page_no"], "\n", "text")


def textbox_words(docs: DataFrame, clip: Rect) -> DataFrame:
    """(doc_id, page_no, text): words that meet the clip, by block and line."""
    by_line = _joined(words_in(docs, clip), "word", ["word_no"], ["doc_id", "page_no", "block_no", "line_no"], " ", "line")
    return _joined(by_line, "line", ["block_no", "line_no"], ["doc_id", "page_no"], "\n", "text")


def selection(docs: DataFrame, ax: float, ay: float, bx: float, by: float) -> DataFrame:
    """(doc_id, page_no, text): characters in reading order between two points, each taken
    to its line band; full lines between, parts of the first and last."""
    rows = virtual.chars(docs)
    after = (F.col("y0") > ay) | ((F.col("y1") > ay) & (F.col("x1") > ax))
    before = (F.col("y1") <= by) | ((F.col("y0") <= by) & (F.col("x0") <= bx))
    by_line = _joined(rows.filter(after & before), "c", ["char_no"], ["doc_id", "page_no", "block_no", "line_no"], "", "line")
    return _joined(by_line, "line", ["block_no", "line_no"], ["doc_id", "page_no"], "\n", "text")


def fold(text: Column) -> Column:
    """Composed, lower-case, with single spaces (Spark has no normalising function)."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFC", t).lower().split()))

    return run(text)


def _hits(text: Column, needle: str) -> Column:
    """0-based code-point offsets of the non-overlapping matches of a literal needle."""
    n = len(needle)
    pieces = F.split(text, F.lit("\\Q" + needle + "\\E"), -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, p: F.struct((acc["at"] + F.char_length(p) + n).alias("at"), F.concat(acc["out"], F.array(acc["at"] + F.char_length(p))).alias("out"))
    all_ = F.aggregate(pieces, start, step, lambda a: a["out"])
    return F.slice(all_, 1, F.size(all_) - 1)


def search(docs: DataFrame, needle: str, hit_max: int | None = None) -> DataFrame:
    """(doc_id, page_no, hit_no, line_part, x0, y0, x1, y1): a box per hit and line, hits
    across line ends included, in any case.

    Lines of a page are joined by spaces; texts without the needle are dropped before the
    characters are placed, so only pages with hits are spread out.  ``hit_max`` keeps the
    first so many hits of a page.
    """
    needle = " ".join(unicodedata.normalize("NFC", needle).lower().split())
    rows = virtual.numbered_lines(docs).withColumn("low", F.lower("text"))
    pages = rows.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("row", "low", "y0", "y1"))).alias("ls"))
    pages = pages.withColumn("joined", F.array_join(F.transform("ls", lambda s: s["low"]), " ")).filter(F.contains("joined", F.lit(needle)))
    hits = pages.select("doc_id", "page_no", "ls", F.posexplode(_hits(F.col("joined"), needle)).alias("hit_no", "at"))
    if hit_max is not None:
        hits = hits.filter(F.col("hit_no") < hit_max)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    starts = F.aggregate("ls", zero, lambda a, s: F.struct((a["at"] + F.char_length(s["low"]) + 1).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
    parts = hits.withColumn("starts", starts).select("doc_id", "page_no", "hit_no", "at", "starts", F.posexplode("ls").alias("k", "l"))
    first = F.col("at") - F.element_at("starts", F.col("k") + 1)
    lo, hi = F.greatest(first, F.lit(0)), F.least(first + len(needle), F.char_length("l.low"))
    parts = parts.withColumns({"lo": lo, "hi": hi}).filter("lo < hi")
    part = F.row_number().over(Window.partitionBy("doc_id", "page_no", "hit_no").orderBy("k")) - 1
    return parts.select("doc_id", "page_no", F.col("hit_no").cast("int").alias("hit_no"), part.cast("int").alias("line_part"), (virtual.MARGIN + F.col("lo") * virtual.ADVANCE).alias("x0"), F.col("l.y0").alias("y0"), (virtual.MARGIN + F.col("hi") * virtual.ADVANCE).alias("x1"), F.col("l.y1").alias("y1"))
