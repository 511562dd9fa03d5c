"""Order and structure: columns by recursive cuts, right-to-left runs, table similarity."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Box = tuple[float, float, float, float]


# --- reading order ----------------------------------------------------------------------------


def widest_gap(intervals: list[tuple[float, float]], least: float) -> float | None:
    """Middle of the widest empty stretch between intervals, if it is wide enough."""
    best, where, reach = least, None, None
    for lo, hi in sorted(intervals):
        if reach is not None and lo - reach >= best:
            best, where = lo - reach, (lo + reach) / 2
        reach = hi if reach is None else max(reach, hi)
    return where


def reading_order(boxes: list[Box], column_gap: float = 10.0, row_gap: float = 6.0) -> list[int]:
    """Indices of boxes in reading order, by recursive XY cuts: columns left to right where an
    empty stretch runs all the way down, else bands from the top, else by position."""
    out: list[int] = []
    todo = [list(range(len(boxes)))]
    while todo:
        part = todo.pop()
        if len(part) < 2:
            out += part
            continue
        cut, axis = None, 0
        for axis, gap in ((0, column_gap), (1, row_gap)):
            cut = widest_gap([(boxes[i][axis], boxes[i][axis + 2]) for i in part], gap)
            if cut is not None:
                break
        if cut is None:
            out += sorted(part, key=lambda i: (boxes[i][1], boxes[i][0]))
        else:
            todo += [[i for i in part if boxes[i][axis] >= cut], [i for i in part if boxes[i][axis] < cut]]
    return out


def ordered_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, page_no, seq, x0, y0, x1, y1, text) with seq in reading order: one page is one
    group, and no page is bounded by more than its own lines."""

    def run(page: pd.DataFrame) -> pd.DataFrame:
        order = reading_order(list(page[["x0", "y0", "x1", "y1"]].itertuples(index=False, name=None)))
        return page.iloc[order].assign(seq=np.arange(len(page), dtype=np.int32))[["doc_id", "page_no", "seq", "x0", "y0", "x1", "y1", "text"]]

    return lines.select("doc_id", "page_no", "x0", "y0", "x1", "y1", "text").groupBy("doc_id", "page_no").applyInPandas(run, "doc_id long, page_no int, seq int, x0 double, y0 double, x1 double, y1 double, text string")


def first_fit_baselines(glyphs: list[tuple[float, float]]) -> list[int]:
    """Line of each (baseline, size) in paint order: the first line whose representative is
    within half the larger size, else a new one."""
    lines: list[tuple[float, float]] = []
    out = []
    for y, size in glyphs:
        for k, (ly, ls) in enumerate(lines):
            if abs(y - ly) <= 0.5 * max(size, ls):
                out.append(k)
                break
        else:
            out.append(len(lines))
            lines.append((y, size))
    return out


def is_rtl(text: str) -> bool:
    """Whether more than half of the letters run from right to left."""
    kinds = [unicodedata.bidirectional(c) in ("R", "AL") for c in text if c.isalpha()]
    return 2 * sum(kinds) > len(kinds)


def logical_order(text: str) -> str:
    """A line in visual order, left to right, as it is read: right-to-left runs are turned,
    and numbers and words of the other direction keep theirs."""
    if not is_rtl(text):
        return text
    runs: list[list] = []
    for c in text:
        kind = unicodedata.bidirectional(c)
        way = "R" if kind in ("R", "AL") else "L" if kind in ("L", "EN", "AN") else "N"
        if runs and (runs[-1][0] == way or way == "N" and runs[-1][0] == "R"):
            runs[-1][1] += c
        elif way == "N" and runs and runs[-1][0] == "L":
            runs.append(["N", c])
        else:
            runs.append([way, c])
    return "".join(t if way == "L" else t[::-1] for way, t in reversed(runs))


# --- table similarity --------------------------------------------------------------------------


def lcs_similarity(a: str, b: str) -> float:
    """Twice the characters in matching blocks over both lengths; 1 for two empty strings.
    The blocks are the longest common run and, on either side of it, theirs in turn."""
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def box_overlap(a: Box, b: Box) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    total = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / total if total else 0.0


def text_grid(cells: list[tuple[int, int, int, int, str]]) -> list[list[str]]:
    """Rows of texts from (row, col, row span, col span, text); a spanning cell fills its slots."""
    n, m = max((r + rs for r, _, rs, _, _ in cells), default=0), max((c + cs for _, c, _, cs, _ in cells), default=0)
    out = [[""] * m for _ in range(n)]
    for r, c, rs, cs, text in cells:
        for i in range(rs):
            for j in range(cs):
                out[r + i][c + j] = text
    return out


def span_grid(cells: list[tuple[int, int, int, int, str]]) -> list[list[Box]]:
    """Slots as their cell's box relative to the slot."""
    n, m = max((r + rs for r, _, rs, _, _ in cells), default=0), max((c + cs for _, c, _, cs, _ in cells), default=0)
    out = [[(0.0, 0.0, 1.0, 1.0)] * m for _ in range(n)]
    for r, c, rs, cs, _ in cells:
        for i in range(rs):
            for j in range(cs):
                out[r + i][c + j] = (float(-j), float(-i), float(cs - j), float(rs - i))
    return out


def _aligned(reward: np.ndarray) -> tuple[float, list[tuple[int, int]]]:
    """Best monotone matching of rows to columns of a reward matrix."""
    n, m = reward.shape
    best = np.zeros((n + 1, m + 1))
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            best[i, j] = max(best[i - 1, j - 1] + reward[i - 1, j - 1], best[i - 1, j], best[i, j - 1])
    pairs, i, j = [], n, m
    while i and j:
        if best[i, j] == best[i - 1, j]:
            i -= 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return float(best[n, m]), pairs[::-1]


def grid_similarity(a: list[list], b: list[list], reward) -> float:
    """F-score of the most similar substructures of two grids, rows and columns aligned apart."""
    size = sum(map(len, a)) + sum(map(len, b))
    if not size:
        return 1.0
    if not a or not b or not a[0] or not b[0]:
        return 0.0
    reward = lru_cache(maxsize=None)(reward)
    rows = np.array([[_aligned(np.array([[reward(x, y) for y in q] for x in p]))[0] for q in b] for p in a])
    ta, tb = list(zip(*a)), list(zip(*b))
    cols = np.array([[_aligned(np.array([[reward(x, y) for y in q] for x in p]))[0] for q in tb] for p in ta])
    total = sum(reward(a[i][k], b[j][m]) for i, j in _aligned(rows)[1] for k, m in _aligned(cols)[1])
    return 2 * total / size


def topology_score(a: list, b: list) -> float:
    return grid_similarity(span_grid(a), span_grid(b), box_overlap)


def content_score(a: list, b: list) -> float:
    return grid_similarity(text_grid(a), text_grid(b), lcs_similarity)


def cell_f1(a: list[list[str]], b: list[list[str]]) -> float:
    """F1 of cells equal by row, column and text."""
    x, y = ({(r, c, t) for r, row in enumerate(g) for c, t in enumerate(row)} for g in (a, b))
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0


def matched(a: list[Box], b: list[Box], least: float = 0.5) -> list[tuple[int, int, float]]:
    """Pairs of boxes by overlap, the best first, each used once."""
    all_ = sorted(((box_overlap(p, q), i, j) for i, p in enumerate(a) for j, q in enumerate(b)), key=lambda t: (-t[0], t[1], t[2]))
    out, left, right = [], set(), set()
    for v, i, j in all_:
        if v > least and i not in left and j not in right:
            left.add(i)
            right.add(j)
            out.append((i, j, v))
    return out


def scored_tables(pairs: DataFrame) -> DataFrame:
    """(id, topology, content, f1) of (id, truth, found): arrays of (row, col, row_span,
    col_span, text)."""

    def run(batches):
        for batch in batches:
            rows = []
            for i, t, f in zip(batch["id"], batch["truth"], batch["found"], strict=True):
                a, b = ([(c["row"], c["col"], c["row_span"], c["col_span"], c["text"] or "") for c in (x if x is not None else [])] for x in (t, f))
                rows.append((i, topology_score(a, b), content_score(a, b), cell_f1(text_grid(a), text_grid(b))))
            yield pd.DataFrame(rows, columns=["id", "topology", "content", "f1"])

    return pairs.mapInPandas(run, "id long, topology double, content double, f1 double")
