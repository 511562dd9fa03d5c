import math

import numpy as np

from quire.llm import hnsw


def brute(rows, every=100, k=10):
    rows = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    out = {}
    for i, q in rows:
        if i % every == 0:
            d = sorted((float(np.sqrt(((v - q) ** 2).sum())), j) for j, v in rows if j != i and len(v) == len(q))
            out[i] = d[:k]
    return out


def check(spark, rows, least):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, id string")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want, got = brute(rows), {}
    for r in hnsw.neighbours(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(got[r.query_id])
    hit = total = 0
    for i, w in want.items():
        have = got.get(i, [])
        assert len(have) == len(w)
        hit += len({v for _, v in have} & {v for _, v in w})
        total += len(w)
        assert have == sorted(have)
    assert hit >= least * total, (hit, total)
    return got, want


def test_recall_on_test_data(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD_NODES", 300)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    check(spark, rows, 0.95)


def test_odd_rows_and_copies(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1, 250)]
    rows += [(1000 + i, [1.0] * 8) for i in range(60)] + [(2000, [1.0] * 8), (2000, [1.0] * 8)]
    rows += [(300, None), (400, []), (500, [0.0] * 8), (600, [1.0, None] * 4), (700, [float("nan")] * 8), (800, [float("inf")] * 8), (None, [2.0] * 8), (900, [1.0, 2.0]), (901, [1.0, 3.0])]
    got, want = check(spark, rows, 1.0)
    assert got[2000] == want[2000] and [v for _, v in got[2000]] == list(range(1000, 1010))
    assert got[900] == [(1.0, 901)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert hnsw.neighbours(df).count() == 0
