"""Ruled tables: rules to edges, edges to cells, cells to tables and their texts.

A page is one row with its rules and words in arrays; everything within it is found there,
for all pages of a batch at once, and nothing is joined or shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.functions.text import html_escape
from quire.plans import arrow

PAGE = ["doc_id", "page_no"]
BOX = ["x0", "y0", "x1", "y1"]
CELLS = "array<struct<row:int,col:int,x0:double,y0:double,x1:double,y1:double,row_span:int,col_span:int,text:string>>"
#: A rule is at most so thick and at least so long, and rules this near are one.
TOLERANCE, LEAST = 3.0, 3.0


def gathered(rects: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, page_no, rects, words): relations (doc_id, page_no, x0, y0, x1, y1) and the
    same with word, an array a page."""
    r = rects.groupBy(*PAGE).agg(F.collect_list(F.struct(*BOX)).alias("rects"))
    return r.join(words.groupBy(*PAGE).agg(F.collect_list(F.struct("word", *BOX)).alias("words")), PAGE, "left")


def _change(*keys: np.ndarray) -> np.ndarray:
    """Whether an element differs in any key from the one before; the first one does."""
    out = np.zeros(len(keys[0]), bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def _boxes(column: pa.Array) -> tuple[np.ndarray, pa.Array, list[np.ndarray]]:
    """(page, items, x0 to y1) of an array of boxes a page; a box without a number is none."""
    places = column.value_lengths().fill_null(0).to_numpy()
    items = column.flatten()
    return np.repeat(np.arange(len(column)), places), items, [items.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in BOX]


def joined_rules(page: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, ...]:
    """(page, whether it runs down, pos, lo, hi) in this order: thin rectangles as rules,
    collinear pieces that touch joined."""
    w, h = x1 - x0, y1 - y0
    flat, steep = np.flatnonzero((h <= TOLERANCE) & (w >= LEAST)), np.flatnonzero((w <= TOLERANCE) & (h >= LEAST))
    side = 2 * np.concatenate([page[flat], page[steep]]) + np.repeat([0, 1], [len(flat), len(steep)])
    pos = np.concatenate([(y0 + y1)[flat] / 2, (x0 + x1)[steep] / 2])
    lo, hi = np.concatenate([x0[flat], y0[steep]]), np.concatenate([x1[flat], y1[steep]])
    order = np.lexsort((pos, side))
    side, pos, lo, hi = side[order], pos[order], lo[order], hi[order]
    new = _change(side)
    new[1:] |= pos[1:] - pos[:-1] > TOLERANCE
    first, run = np.flatnonzero(new), np.cumsum(new) - 1
    if not len(first):
        return side, side.astype(bool), pos, lo, hi
    mean = np.add.reduceat(pos, first) / np.diff(np.append(first, len(pos)))
    order = np.lexsort((hi, lo, run))
    run, lo, hi = run[order], lo[order], hi[order]
    # the furthest end so far within the run, by ranks, which are whole numbers
    values, rank = np.unique(hi, return_inverse=True)
    reach = np.maximum.accumulate(run * len(values) + rank)
    new = _change(run)
    new[1:] |= lo[1:] - values[np.maximum(reach[:-1] - run[1:] * len(values), 0)] > TOLERANCE
    at = np.flatnonzero(new)
    run = run[at]
    return side[first][run] // 2, side[first][run] % 2 == 1, mean[run], lo[at], np.maximum.reduceat(hi, at)


def nearest_cells(page: np.ndarray, down: np.ndarray, pos: np.ndarray, lo: np.ndarray, hi: np.ndarray, t: float = TOLERANCE) -> tuple[np.ndarray, ...]:
    """(page, x0, y0, x1, y1): from each corner the nearest fully ruled cell, first down, then
    to the right.  All corners go on side by side from one rule to the next."""
    hp, hlo, hhi, hpage = (a[~down] for a in (pos, lo, hi, page))
    vp, vlo, vhi, vpage = (a[down] for a in (pos, lo, hi, page))
    v_first, v_count = np.searchsorted(vpage, hpage), np.searchsorted(vpage, hpage, "right") - np.searchsorted(vpage, hpage)
    top, left = np.repeat(np.arange(len(hp)), v_count), arrow.ranges(v_first, v_count)
    corner = (vlo[left] <= hp[top] + t) & (hlo[top] <= vp[left] + t) & (hhi[top] > vp[left] + t)
    top, left = top[corner], left[corner]
    low, found = top + 1, []
    while len(top):
        on = np.flatnonzero(low < len(hp))
        on = on[(hpage[low[on]] == hpage[top[on]]) & (vhi[left[on]] >= hp[low[on]] - t)]
        top, left, low = top[on], left[on], low[on]
        ends = (hp[low] > hp[top] + t) & (hlo[low] <= vp[left] + t) & (hhi[low] > vp[left] + t)
        k = np.flatnonzero(ends)
        right, done = left[k] + 1, np.zeros(len(top), bool)
        while len(k):
            on = np.flatnonzero(right < len(vp))
            on = on[(vpage[right[on]] == vpage[left[k[on]]]) & (np.minimum(hhi[top[k[on]]], hhi[low[k[on]]]) >= vp[right[on]] - t)]
            k, right = k[on], right[on]
            closes = (vp[right] > vp[left[k]] + t) & (vlo[right] <= hp[top[k]] + t) & (vhi[right] >= hp[low[k]] - t)
            c, r = k[closes], right[closes]
            found.append((hpage[top[c]], vp[left[c]], hp[top[c]], vp[r], hp[low[c]]))
            done[c] = True
            k, right = k[~closes], right[~closes] + 1
        top, left, low = top[~done], left[~done], low[~done] + 1
    out = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [page[:0], *[pos[:0]] * 4]
    order = np.lexsort((out[3], out[4], out[1], out[2], out[0]))
    out = [c[order] for c in out]
    once = np.flatnonzero(_change(out[0], out[1], out[2]))
    return tuple(c[once] for c in out)


def _ranks(page: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rank of ``low`` among its page's, how many of these lie in [low, high), the distinct
    values' pages, the values)."""
    order = np.lexsort((low, page))
    new = _change(page[order], low[order])
    at = np.empty(len(page), np.int64)
    at[order] = np.cumsum(new) - 1
    pages, values = page[order][new], low[order][new]
    rank = at - np.searchsorted(pages, page)
    span, more = np.ones(len(page), np.int64), np.arange(len(page))
    while len(more):
        next_ = at[more] + span[more]
        more, next_ = more[next_ < len(pages)], next_[next_ < len(pages)]
        more = more[(pages[next_] == page[more]) & (values[next_] < high[more] - 1e-6)]
        span[more] += 1
    return rank, span, pages, values


def _last_at(pages: np.ndarray, values: np.ndarray, page: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The rank on its page of the last of the sorted values not beyond each value, else -1."""
    n = len(pages)
    order = np.lexsort((np.repeat([0, 1], [n, len(page)]), np.concatenate([values, value]), np.concatenate([pages, page])))
    before = np.empty(len(order), np.int64)
    before[order] = np.cumsum(order < n)
    return before[n:] - 1 - np.searchsorted(pages, page)


def cell_texts(cells: tuple, slots: tuple, page: np.ndarray, word: pa.Array, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> pa.Array:
    """The words whose centers lie in each cell, top down and left to right; a center on a
    shared rule counts for both.  Null where there are none."""
    c_page, cx0, cy0, cx1, cy1 = cells
    (row, row_span, tops_page, tops), (col, col_span, lefts_page, lefts) = slots
    some = np.flatnonzero(pc.is_valid(word).to_numpy(zero_copy_only=False) & ~np.isnan(x0 + y0 + x1 + y1))
    cx, cy, page, wx = ((x0 + x1) / 2)[some], ((y0 + y1) / 2)[some], page[some], x0[some]
    n_rows, n_cols = (row + row_span).max(initial=0) + 1, (col + col_span).max(initial=0) + 1
    # the slots of each cell, and the words of a slot and of those it borders on
    size = row_span * col_span
    of = np.repeat(np.arange(len(c_page)), size)
    inner = arrow.ranges(np.zeros(len(size), np.int64), size)
    slot = (c_page[of] * n_rows + row[of] + inner // col_span[of]) * n_cols + col[of] + inner % col_span[of]
    order = np.argsort(slot, kind="stable")
    slot, of = slot[order], of[order]
    k, m = _last_at(tops_page, tops, page, cy), _last_at(lefts_page, lefts, page, cx)
    pairs = []
    for dk, dm in ((0, 0), (1, 0), (0, 1), (1, 1)):
        w = np.flatnonzero((k >= dk) & (m >= dm) & (k - dk < n_rows) & (m - dm < n_cols))
        key = (page[w] * n_rows + k[w] - dk) * n_cols + m[w] - dm
        a, b = np.searchsorted(slot, key), np.searchsorted(slot, key, "right")
        c, w = of[arrow.ranges(a, b - a)], np.repeat(w, b - a)
        inside = (cx[w] >= cx0[c]) & (cx[w] <= cx1[c]) & (cy[w] >= cy0[c]) & (cy[w] <= cy1[c])
        pairs.append((c[inside], w[inside]))
    cell, w = (np.concatenate(p) for p in zip(*pairs, strict=True))
    word = word.take(pa.array(some))
    order = np.lexsort((w, wx[w], cy[w], cell))
    cell, w = cell[order], w[order]
    if (~_change(cell, cy[w], wx[w])).any():  # words in one place: by their letters
        by_word = np.empty(len(word), np.int64)
        by_word[pc.sort_indices(word.cast(pa.binary())).to_numpy()] = np.arange(len(word))
        order = np.lexsort((by_word[w], wx[w], cy[w], cell))
        cell, w = cell[order], w[order]
    once = _change(cell, w)
    cell, w = cell[once], w[once]
    ends = np.searchsorted(cell, np.arange(len(c_page) + 1))
    text = pc.binary_join(arrow.lists(ends, word.take(pa.array(w)).cast(pa.string())), " ")
    return pc.if_else(pa.array(np.diff(ends) > 0), text, pa.scalar(None, pa.string()))


def edges(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, dir, pos, lo, hi) of pages with ``rects``: thin rectangles as rules,
    collinear pieces that touch joined.  A rule is at most 3 points thick and at least 3 long."""
    schema = StructType([pages.schema[c] for c in PAGE] + StructType.fromDDL("dir string, pos double, lo double, hi double").fields)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        page, _, boxes = _boxes(batch.column("rects"))
        page, down, pos, lo, hi = joined_rules(page, *boxes)
        if len(page):
            ways = pa.array(["h", "v"]).take(pa.array(down.astype(np.int8)))
            yield arrow.batch({**{c: batch.column(c).take(pa.array(page)) for c in PAGE}, "dir": ways, "pos": pos, "lo": lo, "hi": hi})

    return arrow.mapped(pages.select(*PAGE, "rects"), run, schema)


def filled(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, cells) of pages with ``rects`` and ``words``: the cells of each page in
    rows and columns, with row and col numbers, spans in grid lines, and texts; a page without
    a cell has none."""
    schema = StructType([pages.schema[c] for c in PAGE] + StructType.fromDDL(f"cells {CELLS}").fields)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        page, _, boxes = _boxes(batch.column("rects"))
        cells = nearest_cells(*joined_rules(page, *boxes))
        page, x0, y0, x1, y1 = cells
        if not len(page):
            return
        rows, cols = _ranks(page, y0, y1), _ranks(page, x0, x1)
        w_page, items, w_boxes = _boxes(batch.column("words"))
        text = cell_texts(cells, (rows, cols), w_page, items.field("word"), *w_boxes)
        order = np.lexsort((cols[0], rows[0], page))
        number = lambda a: a[order].astype(np.int32)
        made = {"row": number(rows[0]), "col": number(cols[0]), "x0": x0[order], "y0": y0[order], "x1": x1[order], "y1": y1[order], "row_span": number(rows[1]), "col_span": number(cols[1]), "text": text.take(pa.array(order))}
        first = np.flatnonzero(_change(page[order]))
        at = pa.array(page[order][first])
        yield arrow.batch({**{c: batch.column(c).take(at) for c in PAGE}, "cells": arrow.lists(np.append(first, len(page)), arrow.structs(made))})

    return arrow.mapped(pages.select(*PAGE, "rects", "words"), run, schema)


def cells(filled: DataFrame) -> DataFrame:
    """(doc_id, page_no, row, col, x0, y0, x1, y1, row_span, col_span, text): a row a cell."""
    return filled.select(*PAGE, F.explode("cells").alias("c")).select(*PAGE, "c.*")


def _by_row(opens: str, cell, closes) -> Column:
    """Strings of cells, with one before each row and what ``closes`` gives after it."""
    of = lambda i: F.try_element_at("cells", i)["row"]

    def one(c, i):
        first, last = (i == 0) | (of(F.greatest(i, F.lit(1))) != c["row"]), F.coalesce(of(i + 2) != c["row"], F.lit(True))
        return F.concat(F.when(first, opens).otherwise(""), cell(c), F.when(last, closes(c)).otherwise(""))

    return F.array_join(F.transform("cells", one), "")


def markdown(filled: DataFrame) -> DataFrame:
    """(doc_id, page_no, out): a pipe table whose first row is the header."""
    cell = lambda c: F.concat(F.replace(F.replace(F.coalesce(c["text"], F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>")), F.lit("|"))
    rule = F.concat(F.lit("\n"), F.repeat(F.lit("|---"), F.size(F.filter("cells", lambda c: c["row"] == 0))), F.lit("|\n"))
    return filled.select(*PAGE, _by_row("|", cell, lambda c: F.when(c["row"] == 0, rule).otherwise("\n")).alias("out"))


def html(filled: DataFrame) -> DataFrame:
    """(doc_id, page_no, out): an HTML table with row and column spans."""
    span = lambda c, k: F.when(c[f"{k}_span"] > 1, F.concat(F.lit(f' {k}span="'), c[f"{k}_span"].cast("string"), F.lit('"'))).otherwise("")
    cell = lambda c: F.concat(F.lit("<td"), span(c, "row"), span(c, "col"), F.lit(">"), html_escape(F.coalesce(c["text"], F.lit(""))), F.lit("</td>"))
    return filled.select(*PAGE, F.concat(F.lit("<table>\n"), _by_row("<tr>", cell, lambda c: F.lit("</tr>\n")), F.lit("</table>\n")).alias("out"))
