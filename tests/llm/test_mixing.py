import re

import numpy as np
import pytest

from quire.llm import mixing as mx
from tests.llm.cases import kept_clashes, odd_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets():
    got = mx.targets({"a": 1000, "b": 10, "c": 500, None: 300})
    assert got["b"] == 30.0
    assert sum(got.values()) == pytest.approx(1810)
    assert got["a"] / got["c"] == pytest.approx(1 / 3) and got[None] == pytest.approx(got["a"])
    assert mx.targets({}) == {} and mx.targets({"a": 0, "b": 0}) == {"a": 0.0, "b": 0.0}


def test_permutations():
    for n in (1, 2, 3, 17, 1000):
        for key in (1, 2**63):
            got = mx.feistel(np.arange(n), np.full(n, n), np.full(n, key, np.uint64))
            assert sorted(got) == list(range(n))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_mix_of_test_data(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    got = mx.mix(docs).toPandas()
    want = {r.doc_id: (len(WORD.findall(r.text or "")), r.source) for r in docs.collect()}
    assert {i: s for i, s in zip(got.doc_id, got["size"])} == {i: w[0] for i, w in want.items()}
    got["source"] = [want[i][1] for i in got.doc_id]
    by = got.groupby("source").agg(size=("size", "sum"), stated=("source_size", "max"), target=("target", "max"), taken=("taken", "sum"))
    assert (by["size"] == by["stated"]).all()
    goal = mx.targets(by["size"].to_dict())
    assert all(goal[s] == pytest.approx(t) for s, t in by["target"].items())
    assert (abs(by["taken"] - by["target"]) <= 0.02 * by["target"] + 3 * mx.BLOCK_WORDS).all()
    assert (got.taken <= 3 * got["size"]).all()
    again = mx.mix(docs.repartition(3)).toPandas()
    assert dict(zip(again.doc_id, again.taken)) == dict(zip(got.doc_id, got.taken))
    out = mx.mixed_documents(docs).toPandas()
    assert list(out.columns) == docs.columns
    words = out.assign(n=[len(WORD.findall(t)) for t in out.text]).groupby("doc_id").n.sum()
    assert words.to_dict() == {i: t for i, t in zip(got.doc_id, got.taken) if t}


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = mx.mix(docs).collect()
    assert len(got) == docs.count()
    assert all(r.taken == 0 for r in got if r["size"] == 0)
    mixed = mx.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0 and kept_clashes(mixed.collect())
    assert mx.mix(docs.limit(0)).count() == 0
    assert mx.mixed_documents(docs.limit(0)).count() == 0


def test_shards_share_the_totals_out(monkeypatch):
    totals = np.array([30_000, 5_000, 17, 0, 70_000], np.int64)
    shards = -(-int(totals.sum()) // mx.SHARD_SLOTS)
    got = dict(mx.shard_counts(totals, 0, shards, 1))
    assert sorted(got) == list(range(shards))
    assert (sum(got.values()) == totals).all()
    assert all(c.sum() == mx.SHARD_SLOTS for k, c in got.items() if k < shards - 1)
    for a, b in ((0, 3), (3, 11), (11, shards)):  # any task finds its own
        assert all((c == got[k]).all() for k, c in mx.shard_counts(totals, a, b, 1))
    draws = np.array([dict(mx.shard_counts(totals, 0, 1, seed))[0] for seed in range(400)])
    share = totals / totals.sum()
    assert np.allclose(draws.mean(0), mx.SHARD_SLOTS * share, atol=8)  # and spread as a multinomial draw without replacement
    spread = mx.SHARD_SLOTS * share * (1 - share) * (1 - mx.SHARD_SLOTS / totals.sum())
    assert np.allclose(draws.var(0), spread, rtol=0.35, atol=1)
    monkeypatch.setattr(mx, "DRAWN_MOST", 100)
    assert (sum(c for _, c in mx.shard_counts(totals, 0, shards, 1)) == totals).all()


def test_totals_are_whole_and_bounded():
    got = mx.whole_totals(np.array([10.5, 3.25, 0.25]), np.array([10, 30, 30]))
    assert got.sum() == 14 and got[0] == 10
