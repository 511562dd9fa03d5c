import random
import re

import numpy as np
import pytest

from quire.llm import ngram_join as nj
from quire.llm import set_join as sj
from tests.llm.cases import odd_documents


def shingle_set(text, size=5):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower() if (text or "").isascii() else re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode()))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for t in s:
            by.setdefault(t, []).append(i)
    near = {(i, j) for g in by.values() for i in g for j in g if i < j}
    for i, j in near:
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        low[r] = min(x for x in (low.get(r), d) if x is not None) if (low.get(r), d) != (None, None) else None
    return [(d, len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows)]


def near_copies(n, words, edits, seed):
    random.seed(seed)
    base = [f"b{seed}x{k}" for k in range(words)]
    for _ in range(n):
        w = list(base)
        for _ in range(random.randint(0, edits)):
            w[random.randrange(words)] = f"e{random.randrange(10**9)}"
        yield " ".join(w)


def test_more_names_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(sj, "SENT_NAMES", 3)
    monkeypatch.setattr(sj, "ROUND_ZERO", 1)
    docs = odd_documents(spark, [(500 + k, t, "en", "s") for k, t in enumerate(near_copies(25, 80, 3, 5))])
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted(map(tuple, nj.near_duplicates(docs).collect()), key=repr)
    assert got == sorted(brute(rows), key=repr)


@pytest.mark.parametrize("hot_rows", [None, 3])
def test_components_match_brute_force(spark, monkeypatch, hot_rows):
    if hot_rows:  # tokens in many cells, and pairs in many batches
        monkeypatch.setattr(sj, "HOT_ROWS", hot_rows)
        monkeypatch.setattr(sj, "PAIR_BATCH", 50)
        monkeypatch.setattr(sj, "HELD_POSTINGS", 100)
    extra, k = [], 1000
    for words, edits, n, seed in ((100, 3, 60, 1), (60, 2, 90, 2), (30, 1, 50, 3), (200, 9, 40, 4)):
        for t in near_copies(n, words, edits, seed):
            extra.append((k, t, "en", "s"))
            k += 1
    random.seed(9)
    common = " ".join(f"c{j}" for j in range(50))
    for j in range(60):
        extra.append((k, common + " " + " ".join(f"u{j}y{i}" for i in range(random.randint(1, 60))), "en", "s"))
        k += 1
    docs = odd_documents(spark, extra)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted(map(tuple, nj.near_duplicates(docs).collect()), key=repr)
    assert got == sorted(brute(rows), key=repr)


def test_test_data(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, nj.near_duplicates(docs).collect())) == sorted(brute(rows))


def test_empty_table(spark):
    assert nj.near_duplicates(odd_documents(spark).limit(0)).count() == 0


def test_words_are_cut_alike_in_long_texts(monkeypatch):
    text = (" \t".join(f"Wörd{k}" for k in range(3000)) + " " + "x" * 5000 + "\ny").encode()
    starts, whole = sj.word_hashes(text)
    monkeypatch.setattr(sj, "SLICE_BYTES", 300)
    again, parts = sj.word_hashes(text)
    assert (starts == again).all() and (whole == parts).all()
    assert len(np.unique(whole)) == 3002


def test_verify_is_exact():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 200), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.choice([0.8, 0.9, 0.95])], rng.integers(0, 2**63, rng.integers(0, 20), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        want = both if 100 * both >= 80 * (len(a) + len(b) - both) else -1
        assert sj.verify(a.tobytes(), b.tobytes()) == want


def test_one_row_of_each_component_stays_where_ids_repeat(spark):
    alone = "a standalone text that no other row is like at all"
    docs = odd_documents(spark, [(None, alone, "en", "c"), (None, " ".join(f"n{k}" for k in range(90)), "en", "c"), (None, " ".join(f"n{k}" for k in range(90)), "en", "c")])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    at = [(k, t) for k, (_, t) in enumerate(rows)]
    best = {}
    for (k, _, c), (i, t) in zip(brute(at), rows, strict=True):
        best[c] = min(best.get(c, (True, 0, "~")), (i is None, i or 0, t or ""))
    got = nj.one_of_each(docs)
    assert got.columns == docs.columns
    got = [(r.doc_id is None, r.doc_id or 0, r.text or "") for r in got.collect()]
    assert sorted(got) == sorted(best.values())
    assert sum(t == alone for *_, t in got) == 1
    assert any(t.startswith("é ß") for *_, t in got) and not any(t.endswith(" tail") for *_, t in got)


def test_no_pair_is_judged_twice(spark, monkeypatch):
    judged = []
    verified = sj.verified

    def counted(pairs, sets):
        judged.extend(map(tuple, pairs.select("a", "b").collect()))
        return verified(pairs, sets)

    monkeypatch.setattr(sj, "verified", counted)
    rows = [(k, t, "en", "s") for k, t in enumerate(near_copies(150, 60, 6, 8))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = sorted(map(tuple, nj.near_duplicates(docs).collect()))
    assert got == sorted(brute([r[:2] for r in rows]))
    assert len(judged) == len(set(judged)) > 20 and all(a < b for a, b in judged)


def test_only_postings_that_meet_another_are_sent_whole(spark, monkeypatch):
    sent = []
    deal = sj.deal

    def counted(rows):
        width = sum(np.dtype(t).itemsize for t in (sj.POSTING if sent else sj.BRIEF))
        sent.append(rows.filter(f"kind = {sj.POSTINGS}").selectExpr("sum(octet_length(body))").first()[0] // width)
        return deal(rows)

    monkeypatch.setattr(sj, "deal", counted)
    # as in a large corpus, where the sketch tells hardly any shingle from another
    monkeypatch.setattr(sj, "sketch", lambda rows: np.full(1 << sj.SKETCH_BITS, 50, np.int32))
    passage = lambda k: " ".join(f"p{k}x{i}" for i in range(30))
    rows = [(k, " ".join(f"u{k}x{i}" for i in range(300)) + " " + passage(k // 2)) for k in range(60)]
    rows += [(60, rows[0][1] + " more")]
    got = sorted(map(tuple, nj.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == sorted(brute(rows))
    assert got[60][2] == 0
    assert sent[0] > 3600 and 0 < sent[1] < 800  # whole ones of all documents before, as each shares a key


@pytest.mark.parametrize("crowd", [0, 256])
def test_brief_postings_that_meet_are_found(monkeypatch, crowd):
    monkeypatch.setattr(sj, "CROWD", crowd)
    monkeypatch.setattr(sj, "PAIR_BATCH", 20)
    rng = np.random.default_rng(4)
    group, n = rng.integers(0, 25, 120), rng.choice([3, 20, 22, 30, 31, 90, sj.BRIEF_MOST], 120)
    pos = (n * rng.random(120) * 0.25).astype(np.int64)
    o = np.lexsort((n, group))
    group, n, pos = group[o], n[o], pos[o]
    got = sj._met(group, n, pos)
    for i in range(120):
        others = [j for j in range(120) if j != i and group[j] == group[i] and 5 * min(n[i], n[j]) >= 4 * max(n[i], n[j])]
        filtered = [j for j in others if max(n[i], n[j]) == sj.BRIEF_MOST or min(n[i] - pos[i], n[j] - pos[j]) * 180 >= 80 * (n[i] + n[j])]
        assert got[i] == bool(filtered if crowd else others)
