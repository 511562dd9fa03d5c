"""From positioned glyphs to lines and words, by ordered windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.plans import arrow

#: White space of Unicode and the no-break space.
BLANK = r"^(?U)[\s\xA0]+$"


def upper_median(values: Column) -> Column:
    """Element n/2 of the sorted values, not the mean of the middle two."""
    return F.element_at(F.array_sort(values), (F.size(values) / 2).cast("int") + 1)


def lines(glyphs: DataFrame) -> DataFrame:
    """``glyphs`` with line_no: glyphs whose baselines lie within half their size of the one
    before, from the top down, share a line."""
    page = Window.partitionBy("doc_id", "page_no").orderBy("oy", "ox", "seq")
    step = F.when(F.col("oy") - F.lag("oy").over(page) > 0.5 * F.col("size"), 1).otherwise(0)
    return glyphs.withColumn("_new", step).withColumn("line_no", F.sum("_new").over(page).cast("int")).drop("_new")


def words(glyphs: DataFrame) -> DataFrame:
    """(doc_id, page_no, line_no, word_no, word, x0, y0, x1, y1): a word ends at white space
    or a gap of more than a fifth of the height."""
    in_line = Window.partitionBy("doc_id", "page_no", "line_no").orderBy("ox", "seq")
    blank = F.col("unicode").rlike(BLANK)
    gap = F.col("x0") - F.lag("x1").over(in_line) > 0.2 * (F.col("y1") - F.col("y0"))
    start = F.when(blank | F.lag(blank).over(in_line) | gap, 1).otherwise(0)
    marked = lines(glyphs).withColumn("_s", start).withColumn("_k", F.sum("_s").over(in_line)).filter(~blank)
    key = ["doc_id", "page_no", "line_no", "_k"]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ox", "seq", "unicode"))), lambda s: s["unicode"]), "")
    out = marked.groupBy(*key).agg(text.alias("word"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    no = F.row_number().over(Window.partitionBy("doc_id", "page_no", "line_no").orderBy("_k")) - 1
    return out.select("doc_id", "page_no", "line_no", no.cast("int").alias("word_no"), "word", "x0", "y0", "x1", "y1")


#: The white space of ``BLANK``: the property White_Space of Unicode.
SPACES = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def words_of(page: np.ndarray, seq: np.ndarray, unicode: pa.Array, ox: np.ndarray, oy: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, dict]:
    """``words`` of glyphs in arrays: each word's page, and its other columns.  All glyphs of a
    page are given, those of one page after the other."""
    n = len(page)
    kinds = unicode.dictionary_encode()
    is_blank = np.array([bool(c) and SPACES.issuperset(c) for c in kinds.dictionary.to_pylist()], bool)
    blank = is_blank[kinds.indices.to_numpy()] if n else np.zeros(0, bool)

    def order_of(*keys: np.ndarray) -> np.ndarray | None:
        """The stable order by keys, the first one leading; None where it is so already."""
        less, same = np.zeros(max(n - 1, 0), bool), np.ones(max(n - 1, 0), bool)
        for k in keys:
            less |= same & (k[:-1] < k[1:])
            same &= k[:-1] == k[1:]
        return None if (less | same).all() else np.lexsort(keys[::-1])

    def moved(order: np.ndarray | None, *arrays: np.ndarray) -> tuple[np.ndarray, ...]:
        return arrays if order is None else tuple(a[order] for a in arrays)

    at = np.arange(n)
    change = lambda a: np.append(True, a[1:] != a[:-1])[: len(a)]
    at, page, seq, ox, oy, x0, y0, x1, y1, size, blank = moved(order_of(page, oy, ox, seq), at, page, seq, ox, oy, x0, y0, x1, y1, size, blank)
    new_page = change(page)
    line = np.cumsum(new_page | np.append(True, oy[1:] - oy[:-1] > 0.5 * size[1:])[:n])
    at, page, line, seq, ox, x0, y0, x1, y1, blank = moved(order_of(line, ox, seq), at, page, line, seq, ox, x0, y0, x1, y1, blank)
    new_page, new_line = change(page), change(line)
    start = new_line | blank
    start[1:] |= ~new_line[1:] & (blank[:-1] | (x0[1:] - x1[:-1] > 0.2 * (y1[1:] - y0[1:])))
    word = np.cumsum(start)
    kept = np.flatnonzero(~blank)
    at, page, line, word, x0, y0, x1, y1 = moved(kept, at, page, line, word, x0, y0, x1, y1)
    first = np.flatnonzero(change(word))
    low, high = (lambda a: np.minimum.reduceat(a, first) if len(first) else a), (lambda a: np.maximum.reduceat(a, first) if len(first) else a)
    data, ends = arrow.string_parts(unicode)
    width = ends[at + 1] - ends[at]
    text = arrow.strings(data[arrow.ranges(ends[at], width)], np.append(0, np.cumsum(width))[np.append(first, len(at))])
    page_of, line_of = page[first], line[first]
    top = line_before(new_page, new_line)
    no = np.arange(len(first)) - np.flatnonzero(change(line_of))[np.cumsum(change(line_of)) - 1] if len(first) else first
    made = {"line_no": (top[line_of - 1]).astype(np.int32), "word_no": no.astype(np.int32), "word": text, "x0": low(x0), "y0": low(y0), "x1": high(x1), "y1": high(y1)}
    return page_of, made


def line_before(new_page: np.ndarray, new_line: np.ndarray) -> np.ndarray:
    """The number on its page of each line, given where glyphs begin a page and a line."""
    first = np.flatnonzero(new_line)
    opens = new_page[first]
    return np.arange(len(first)) - np.flatnonzero(opens)[np.cumsum(opens) - 1] if len(first) else first


def space_gaps(glyphs: DataFrame, ratio: float = 0.2) -> DataFrame:
    """(doc_id, page_no, line_no, text): lines with a space put where a gap calls for one."""
    w = words(glyphs)
    return w.groupBy("doc_id", "page_no", "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "word"))), lambda s: s["word"]), " ").alias("text"))


def snapped(values: DataFrame, by: list[str], value: str, tolerance: float) -> DataFrame:
    """(*by, value): means of runs of sorted values whose steps are within the tolerance."""
    w = Window.partitionBy(*by).orderBy(value)
    run = values.select(*by, value).withColumn("_n", F.when(F.col(value) - F.lag(value).over(w) > tolerance, 1).otherwise(0)).withColumn("_r", F.sum("_n").over(w))
    return run.groupBy(*by, "_r").agg(F.avg(value).alias(value)).drop("_r")


def bands(items: DataFrame, by: list[str], low: str, high: str, gap: float) -> DataFrame:
    """(*by, band, low, high): islands of intervals whose distances don't exceed a gap."""
    w = Window.partitionBy(*by).orderBy(low, high)
    reach = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    run = items.withColumn("_n", F.when(F.col(low) - reach > gap, 1).otherwise(0)).withColumn("band", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return run.groupBy(*by, "band").agg(F.min(low).alias(low), F.max(high).alias(high))
