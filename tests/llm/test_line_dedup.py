import hashlib
import random
import re

import pytest

from quire.llm import line_dedup as ld
from quire.llm import set_join as sj
from tests.llm.cases import kept_clashes, odd_documents


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    """rows: (doc_id, text hash, text, row number)"""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or 0))
    lines = [(k, j, frozenset(re.findall(r"[^\x20\x09-\x0D]+", lower(x)))) for k, r in enumerate(rows) if r[2] is not None for j, x in enumerate(r[2].split("\n"))]
    drop, holders = set(), {}
    for i, (k, j, s) in enumerate(lines):
        if s:
            near = {m for t in s for m in holders.get(t, ())}
            if any(100 * len(s & lines[m][2]) >= 80 * len(s | lines[m][2]) for m in near):
                drop.add((k, j))
            for t in s:
                holders.setdefault(t, []).append(i)
    out = []
    for k, (d, _, text) in enumerate(r[:3] for r in rows):
        all_lines = [] if text is None else text.split("\n")
        kept = "\n".join(x for j, x in enumerate(all_lines) if (k, j) not in drop)
        out.append((d, len(all_lines), sum((k, j) in drop for j in range(len(all_lines))), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("hot_rows", [None, 3])
def test_kept_lines_match_brute_force(spark, monkeypatch, hot_rows):
    if hot_rows:  # tokens in many cells, and pairs in many batches
        monkeypatch.setattr(sj, "HOT_ROWS", hot_rows)
        monkeypatch.setattr(sj, "PAIR_BATCH", 50)
        monkeypatch.setattr(sj, "HELD_POSTINGS", 100)
    random.seed(4)
    bases = [[f"w{random.randrange(300)}" for _ in range(n)] for n in (3, 8, 12, 25, 60) for _ in range(3)]
    extra = []
    for k in range(150):
        lines = []
        for _ in range(random.randint(1, 6)):
            w = list(random.choice(bases))
            for _ in range(random.choice([0, 0, 1, 1, 2, 4])):
                w[random.randrange(len(w))] = f"z{random.randrange(10**6)}"
            lines.append(random.choice(["", " ", "\t"]) + " ".join(w))
        extra.append((1000 + k, "\n".join(lines), "en", "s"))
    docs = odd_documents(spark, extra)
    rows = [(r.doc_id, r.h, r.text) for r in docs.select("doc_id", ld.F.xxhash64("text").alias("h"), "text").collect()]
    got = sorted(map(tuple, ld.digests(docs).collect()), key=repr)
    assert got == sorted(brute(rows), key=repr)


def test_columns_and_empty_table(spark):
    docs = odd_documents(spark)
    out = ld.dedup_lines(docs, added=("a1", "a2", "a3"))
    assert out.columns == [*docs.columns, "a1", "a2", "a3"]
    assert out.count() == docs.count() and kept_clashes(out.collect())
    assert ld.dedup_lines(docs).columns == [c for c in docs.columns if c != "n_worded"] + ["n_lines", "n_removed", "n_worded"]
    assert ld.digests(docs.limit(0)).count() == 0
