"""Nearest neighbours by hierarchical navigable small-world graphs, one per shard.

Distinct vectors are dealt to shards of bounded size by a hash.  A shard's graph is
stored as flat arrays: vectors, layer sizes, and per layer a table of neighbour numbers
(-1: none).  Nodes are ordered by layer, so those of a layer are the first so many.  A
query descends greedily from the top node and then searches the lowest layer with a beam;
results of all shards are merged by distance.

Rows of equal vectors are one node, which names their smallest ids: no others can be
among the nearest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.shared import written

SHARD_NODES = 2048
#: Links a node makes in upper layers; it keeps twice as many in the lowest.
LINKS = 16
#: Nearest nodes that a new node picks its links from, and width of the search beam.
BUILD_WIDTH, SEARCH_WIDTH = 64, 96
QUERY_BLOCK = 2048


def usable(v: Column) -> Column:
    """Whether a vector takes part: not null, not empty, all components finite, not all zero."""
    x = lambda c: c.cast("double")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(x(c)) & (F.abs(x(c)) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda c: x(c) != 0), F.lit(False))


def _spread(order: np.ndarray, dist: np.ndarray, pair: np.ndarray, most: int) -> list[int]:
    """Of candidates from near to far, those nearer to the node than to any chosen before;
    then the nearest others, up to ``most``."""
    chosen: list[int] = []
    rest: list[int] = []
    for c in order:
        if len(chosen) == most:
            break
        (chosen if not chosen or dist[c] < pair[c, chosen].min() else rest).append(int(c))
    return chosen + rest[: most - len(chosen)]


def build(vectors: np.ndarray, seed: int = 1) -> tuple[np.ndarray, list[int], list[np.ndarray]]:
    """Order of the nodes, layer sizes from the lowest, and neighbour tables.

    A shard is small enough for its distances to be known, so a node's candidates are its
    exactly nearest nodes of the layer; links go both ways and are cut back by ``_spread``.
    """
    n = len(vectors)
    rng = np.random.Generator(np.random.PCG64(seed))
    level = np.floor(-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int)
    order = np.argsort(-level, kind="stable")
    level, x = level[order], vectors[order]
    sq = (x * x).sum(1)
    pair = np.maximum(sq[:, None] + sq[None] - 2 * x @ x.T, 0)
    np.fill_diagonal(pair, np.inf)
    sizes, tables = [], []
    for layer in range(int(level.max()) + 1 if n else 0):
        m = int((level >= layer).sum())
        most = LINKS * (2 if layer == 0 else 1)
        sizes.append(m)
        width = min(BUILD_WIDTH, m - 1)
        links: list[set[int]] = [set() for _ in range(m)]
        if width > 0:
            near = np.argpartition(pair[:m, :m], width - 1, 1)[:, :width]
            for i in range(m):
                order_i = near[i][np.argsort(pair[i, near[i]], kind="stable")]
                for j in _spread(order_i, pair[i], pair, LINKS):
                    links[i].add(j)
                    links[j].add(i)
            # every node after the first also links to the nearest one before it, so that
            # far groups stay joined
            for i in range(1, m):
                j = int(np.argmin(pair[i, :i]))
                links[i].add(j)
                links[j].add(i)
        table = np.full((m, most), -1, np.int32)
        for i, s in enumerate(links):
            got = np.fromiter(s, int, len(s))
            if len(got) > most:
                got = np.array(_spread(got[np.argsort(pair[i, got], kind="stable")], pair[i], pair, most))
            table[i, : len(got)] = got
        tables.append(table)
    return order, sizes, tables


def search(x: np.ndarray, sizes: list[int], tables: list[np.ndarray], queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and squared distances found for each query, nearest first, all queries in step."""
    q, n = len(queries), len(x)
    rows = np.arange(q)
    at = np.zeros(q, np.int64)
    best = ((queries - x[0]) ** 2).sum(1)
    for table in reversed(tables[1:]):
        moved = np.ones(q, bool)
        while moved.any():
            r = rows[moved]
            near = table[at[r]]
            d = ((queries[r, None] - x[near]) ** 2).sum(2)
            d[near < 0] = np.inf
            k = d.argmin(1)
            better = d[np.arange(len(r)), k] < best[r]
            moved[:] = False
            r = r[better]
            at[r], best[r] = near[better, k[better]], d[better, k[better]]
            moved[r] = True
    width = min(width, n)
    node = np.full((q, width), -1, np.int64)
    dist = np.full((q, width), np.inf)
    opened = np.zeros((q, width), bool)
    seen = np.zeros((q, n), bool)
    node[:, 0], dist[:, 0] = at, best
    seen[rows, at] = True
    table = tables[0]
    while True:
        open_ = np.where(opened | (node < 0), np.inf, dist)
        k = open_.argmin(1)
        r = np.flatnonzero(np.isfinite(open_[rows, k]))
        if not len(r):
            break
        opened[r, k[r]] = True
        near = table[node[r, k[r]]]
        new = (near >= 0) & ~seen[r[:, None], near]
        i, j = np.nonzero(new)
        if not len(i):
            continue
        seen[r[i], near[i, j]] = True
        d = np.full(near.shape, np.inf)
        d[i, j] = ((queries[r[i]] - x[near[i, j]]) ** 2).sum(1)
        all_d = np.concatenate([dist[r], d], 1)
        pick = np.argpartition(all_d, width - 1, 1)[:, :width]
        take = lambda a, b: np.take_along_axis(np.concatenate([a, b], 1), pick, 1)  # noqa: E731, B023
        node[r], opened[r] = take(node[r], np.where(new, near, -1)), take(opened[r], np.zeros(near.shape, bool))
        dist[r] = np.take_along_axis(all_d, pick, 1)
    node[~np.isfinite(dist)] = -1
    o = np.argsort(dist, 1, kind="stable")
    return np.take_along_axis(node, o, 1), np.take_along_axis(dist, o, 1)


INDEX = "shard long, nodes int, dims int, vectors binary, ids binary, id_counts binary, sizes array<int>, tables array<binary>"


def build_index(vectors: DataFrame, id_col: str, vector_col: str, keep: int) -> DataFrame:
    """A row per shard; every usable row is indexed through its vector, whose ``keep``
    smallest ids the node names.  Vectors of other lengths are in shards of their own."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(usable(F.col("v")) & F.col("id").isNotNull()).distinct()
    rows = rows.withColumn("v", F.transform("v", lambda c: c + F.lit(0.0)))  # -0.0 is 0.0
    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("k") <= keep)
    nodes = written(ranked.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")), "nodes")
    shards = max(1, -(-nodes.count() * 5 // (4 * SHARD_NODES)))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)) * 65536 + F.size("v"))

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ids", key=lambda c: c.map(lambda a: a[0]))
        shard, x = int(pdf["shard"].iloc[0]), np.stack(pdf["v"].to_numpy())
        out = []
        for a in range(0, len(x), 2 * SHARD_NODES):  # a shard that chance has overfilled is cut
            part = x[a : a + 2 * SHARD_NODES]
            order, sizes, tables = build(part)
            ids = [pdf["ids"].iloc[a + o] for o in order]
            out.append({"shard": shard, "nodes": len(part), "dims": part.shape[1], "vectors": part[order].tobytes(), "ids": np.concatenate(ids).astype("<i8").tobytes(), "id_counts": np.array([len(i) for i in ids], "<i4").tobytes(), "sizes": sizes, "tables": [t.tobytes() for t in tables]})
        return pd.DataFrame(out)

    return written(dealt.groupBy("shard").applyInPandas(make, INDEX), "hnsw-index")


def nearest(index: DataFrame, queries: DataFrame, k: int = 10, width: int = SEARCH_WIDTH) -> DataFrame:
    """(query_id, rank, vec_id, score) from ``queries`` (id, v): the ``k`` nearest rows of
    other ids by Euclidean distance, ties to smaller ids.

    Queries come in blocks; every block meets every shard, which is what a graph per shard
    asks for, and a shard's answer has k rows a query.
    """
    n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    blocks = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)))
    to = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    tasks = to.withColumn("task", F.concat_ws("-", "shard", "block", F.xxhash64("ids")))
    asked = tasks.select("task", "block", "dims").join(blocks, "block").filter(F.size("v") == F.col("dims")).select(F.col("task").alias("to"), "id", "v")

    def answer(key, shard: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(shard) or not len(asks):
            return none
        s = shard.iloc[0]
        x = np.frombuffer(s["vectors"], np.float64).reshape(s["nodes"], s["dims"])
        counts = np.frombuffer(s["id_counts"], "<i4")
        ids, first = np.frombuffer(s["ids"], "<i8"), np.concatenate([[0], np.cumsum(counts)])
        tables = [np.frombuffer(t, np.int32).reshape(m, -1) for t, m in zip(s["tables"], s["sizes"], strict=True)]
        out = [none]
        for a in range(0, len(asks), 256):
            part = asks.iloc[a : a + 256]
            q = np.stack(part["v"].to_numpy())
            node, dist = search(x, list(s["sizes"]), tables, q, width)
            for i, query in enumerate(part["id"]):
                hits = []
                for m, d in zip(node[i], dist[i], strict=True):
                    if m < 0 or len(hits) > k and d > hits[k][0]:
                        break
                    hits += [(d, v) for v in ids[first[m] : first[m + 1]] if v != query]
                    hits.sort()
                hits = hits[:k]
                out.append(pd.DataFrame({"query_id": query, "vec_id": [v for _, v in hits], "score": np.sqrt([d for d, _ in hits])}))
        return pd.concat(out)

    found = tasks.groupBy("task").cogroup(asked.groupBy("to")).applyInPandas(answer, "query_id long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.distinct().withColumn("rank", best.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by ``every``.

    Rows with null ids and vectors that are null, empty, zero or hold null or non-finite
    components take no part; only vectors of a query's length are its candidates; repeated
    rows count once; an id with several vectors answers by its nearest; other columns are
    ignored.
    """
    index = build_index(vectors, id_col, vector_col, k + 1)
    asked = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter((F.col("id") % every == 0) & usable(F.col("v"))).distinct()
    found = nearest(index, asked, k)
    return found
