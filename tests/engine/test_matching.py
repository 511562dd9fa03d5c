"""Matching blocks of many pairs at once against difflib, in few steps for repeated lines."""

import difflib
import random
import time

import numpy as np
import pytest

from quire.operators import matching


def blocks(a, b):
    return sum(x.size for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def at_once(pairs):
    ends = lambda s: np.append(0, np.cumsum([len(x) for x in s])).astype(np.int64)
    flat = lambda s: np.array([v for x in s for v in x], np.int64)
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    return matching.matched(flat(a), ends(a), flat(b), ends(b)).tolist()


def case(rng):
    kinds = rng.choice((1, 2, 3, 5, 30, 300))
    a = [rng.randrange(kinds) for _ in range(rng.choice((0, 1, 5, 20, 60, 200)))]
    b = list(a) if rng.random() < 0.5 else [rng.randrange(kinds) for _ in range(rng.choice((0, 3, 40, 100)))]
    for _ in range(rng.randrange(8)):
        p = rng.randrange(len(b) + 1)
        b[p : p + rng.randrange(6)] = [rng.randrange(kinds + 1) for _ in range(rng.randrange(6))]
    return a, b


@pytest.mark.parametrize("lengths,held", [(matching.LENGTHS, matching.HELD_PAIRS), (((4, 500), (2, 300), (1, 200)), 100), (((3, 0), (1, 10**9)), 7)])
def test_blocks_are_those_of_difflib(lengths, held, monkeypatch):
    monkeypatch.setattr(matching, "LENGTHS", lengths)
    monkeypatch.setattr(matching, "HELD_PAIRS", held)
    rng = random.Random(3)
    pairs = [case(rng) for _ in range(400)]
    assert at_once(pairs) == [blocks(a, b) for a, b in pairs]


def test_a_line_repeated_thousands_of_times():
    """difflib takes more than a minute for such a text of 7,000 words."""
    line = list(range(10))
    cut = lambda n: [w for k in range(n) for w in (*line[:7], *((100, 101) if k % 2 else line[7:8]), *line[8:])]
    assert at_once([(cut(30), line * 30)]) == [blocks(cut(30), line * 30)]
    start = time.process_time()
    got = at_once([(cut(600), line * 600)])[0]
    assert time.process_time() - start < 20 and 3000 <= got <= 5700
