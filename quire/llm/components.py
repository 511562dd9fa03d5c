"""Connected components of a graph of long ids by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import written


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each batch's edges as stars around the smallest node: as many edges at most."""
    for batch in batches:
        nodes, at = np.unique(batch[["u", "v"]].to_numpy(), return_inverse=True)
        at = at.reshape(-1, 2)
        root = np.arange(len(nodes))
        while True:
            low = np.minimum(root[at[:, 0]], root[at[:, 1]])
            before = root.copy()
            np.minimum.at(root, at[:, 0], low)
            np.minimum.at(root, at[:, 1], low)
            root = np.minimum(root, root[root])
            if (root == before).all():
                break
        far = root != np.arange(len(nodes))
        yield pd.DataFrame({"u": nodes[far], "v": nodes[root[far]]})


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v) but the roots themselves; a root is
    its component's smallest node.  Nothing is gathered in one place: an iteration joins
    every edge with its end's smallest neighbour, and the number of iterations is about
    the logarithm of the longest path."""
    edges = written(edges.filter("u <> v").mapInPandas(_forest, "u long, v long").distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = written(small.filter("u <> v").distinct(), "edges")
        after = _mark(edges)
        if after == mark:
            break
        mark = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
