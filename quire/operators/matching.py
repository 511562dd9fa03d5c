"""Matching blocks of many pairs of token lists at once, as ``difflib.SequenceMatcher`` finds
them: the longest common run of a box of both lists (the first of the first list and then of
the second), and so on in the boxes before and after it.

Long runs come first: as long as a box has a common run of at least n tokens, its longest one
is among the runs of n equal tokens or more, so shorter ones, which are many, are looked for
only in the boxes that the long ones leave.
"""

from __future__ import annotations

import difflib

import numpy as np

from quire.plans.arrow import ranges

#: Least lengths of runs, one after the other, with the pairs of equal pieces of a box beyond
#: which difflib, slower but in little memory, takes the box; and pairs that are held at once.
LENGTHS, HELD_PAIRS = ((4, 20_000_000), (2, 4_000_000), (1, 4_000_000)), 1_000_000
_MIX, _BOX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _keys(tokens: np.ndarray, at: np.ndarray, box: np.ndarray, n: int) -> np.ndarray:
    h = tokens[at].astype(np.uint64)
    for k in range(1, n):
        h = h * _MIX + tokens[at + k].astype(np.uint64)
    return (h ^ (h >> np.uint64(29))) * _MIX + box.astype(np.uint64) * _BOX


def _divided(run: tuple, boxes: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Adds the lengths of the blocks of at least n tokens to ``sums``, and gives the boxes
    that are left.  ``run`` are (box, start, end, diagonal) of the common runs, box by box; ``boxes`` has
    rows of start and end in the first list, in the second one, and the pair."""
    box, s, e, d = run
    left, most = [], np.iinfo(np.int64).max
    while True:
        first = np.flatnonzero(np.diff(box, prepend=-1))
        has = np.zeros(len(boxes), bool)
        has[box[first]] = True
        left.append(boxes[~has])
        if not len(first):
            return np.concatenate(left)
        of = np.cumsum(np.diff(box, prepend=-1) != 0) - 1
        size = e - s
        longest = np.maximum.reduceat(size, first)
        bs = np.minimum.reduceat(np.where(size == longest[of], s, most), first)
        bd = np.minimum.reduceat(np.where((size == longest[of]) & (s == bs[of]), d, most), first)
        be, old = bs + longest, boxes[box[first]]
        np.add.at(sums, old[:, 4], be - bs)
        boxes = np.concatenate([np.column_stack([old[:, 0], bs, old[:, 2], bs + bd, old[:, 4]]), np.column_stack([be, old[:, 1], be + bd, old[:, 3], old[:, 4]])])
        # what is left of a run stands before the block in both lists, or after it in both
        before = np.minimum(e, np.minimum(bs[of], bs[of] + bd[of] - d))
        after = np.maximum(s, np.maximum(be[of], be[of] + bd[of] - d))
        one, two = np.flatnonzero(before - s >= n), np.flatnonzero(e - after >= n)
        box = np.concatenate([of[one], of[two] + len(first)])
        s, e, d = np.concatenate([s[one], after[two]]), np.concatenate([before[one], e[two]]), np.concatenate([d[one], d[two]])
        some = (boxes[:, 0] < boxes[:, 1]) & (boxes[:, 2] < boxes[:, 3])
        box, boxes = (np.cumsum(some) - 1)[box], boxes[some]


def matched(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """The tokens in matching blocks of each pair: tokens are whole numbers, those of pair k
    stand at ``ends[k]`` to ``ends[k + 1]``."""
    n_pairs = len(a_ends) - 1
    sums = np.zeros(n_pairs, np.int64)
    boxes = np.column_stack([a_ends[:-1], a_ends[1:], b_ends[:-1], b_ends[1:], np.arange(n_pairs)])
    boxes = boxes[(boxes[:, 0] < boxes[:, 1]) & (boxes[:, 2] < boxes[:, 3])]
    for n, most in LENGTHS:
        sizes = (np.maximum(boxes[:, k + 1] - boxes[:, k] - n + 1, 0) for k in (0, 2))
        (i, in_a), (j, in_b) = ((ranges(boxes[:, k], size), np.repeat(np.arange(len(boxes)), size)) for k, size in zip((0, 2), sizes, strict=True))
        key = _keys(b, j, in_b, n)
        order = np.argsort(key, kind="stable")
        key, j = key[order], j[order]
        wanted = _keys(a, i, in_a, n)
        low = np.searchsorted(key, wanted)
        count = np.searchsorted(key, wanted, "right") - low
        pairs = np.bincount(in_a, count, len(boxes)).astype(np.int64)
        for alo, ahi, blo, bhi, k in boxes[pairs > most].tolist():
            blocks = difflib.SequenceMatcher(None, a[alo:ahi].tolist(), b[blo:bhi].tolist(), autojunk=False).get_matching_blocks()
            sums[k] += sum(x.size for x in blocks)
        mine = np.flatnonzero((count > 0) & (pairs <= most)[in_a])
        part = np.cumsum(count[mine]) // HELD_PAIRS
        cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(mine))
        found = [_runs(a, b, boxes, n, i[own], in_a[own], j, low[own], count[own]) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True) for own in [mine[lo:hi]]]
        run = tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (mine,) * 4
        box, s, e, d = _joined(*run)
        kept = pairs <= most
        boxes = _divided(((np.cumsum(kept) - 1)[box], s, e + n - 1, d), boxes[kept], n, sums)
    return sums


def _runs(a: np.ndarray, b: np.ndarray, boxes: np.ndarray, n: int, i: np.ndarray, in_a: np.ndarray, j: np.ndarray, low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """(box, start, end, diagonal) of the places of the first list whose next n tokens stand
    also in the second: ``count`` candidates of each in ``j`` from ``low`` on."""
    s, box, t = np.repeat(i, count), np.repeat(in_a, count), j[ranges(low, count)]
    same = np.flatnonzero((boxes[box, 2] <= t) & (t + n <= boxes[box, 3]))
    s, box, t = s[same], box[same], t[same]
    equal = np.ones(len(s), bool)
    for k in range(n):
        equal &= a[s + k] == b[t + k]
    s, box, d = s[equal], box[equal], (t - s)[equal]
    return _joined(box, s, s + 1, d)


def _joined(box: np.ndarray, s: np.ndarray, e: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs that follow each other on a diagonal of a box as one."""
    order = np.lexsort((s, d, box))
    box, s, e, d = box[order], s[order], e[order], d[order]
    new = np.ones(len(s), bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] != e[:-1]) | (box[1:] != box[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(s))[: len(first)] - 1
    return box[first], s[first], e[last], d[first]
