"""Mixing sources to target weights by blocks.

Each source's texts, in the order of a hash, form one stream of words, cut into blocks of
a fixed length.  Output shards have a fixed number of slots, a block each.  Every shard
draws at random how many of its slots each source gets: a multinomial draw, conditioned on
the sources' totals over all shards, which are their targets.  Such draws are made by
halves: of the slots of a range of shards, the first half's draw leaves the second half's
(a multivariate hypergeometric one), each with a generator of its own, so that any task
finds its shards' counts alone.  A source's slots are numbered through; slot number j
stands for block ``permutation(j mod blocks)`` of a pseudorandom permutation of its own
for each round through the blocks.  Slots and texts are then joined by block number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.shared import BUCKET_ROWS, bound_batches, inner_names, running_total, written

BLOCK_WORDS = 64
SHARD_SLOTS = 4096
#: Weights of the sources in order, repeating, and how often a source may be gone through.
WEIGHTS = (1, 2, 3)
MOST_ROUNDS = 3
#: Totals from which a half is taken by its share and only what is left over is drawn.
DRAWN_MOST = 500_000_000
#: Shards whose counts are summed together.
SHARD_BUCKET = 4096
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    """Words that each source should give: all words shared by weight, but none over
    ``MOST_ROUNDS`` times its size; what is over is shared again by weight."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: WEIGHTS[k % len(WEIGHTS)] for k, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left, open_ = float(sum(sizes.values())), list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > MOST_ROUNDS * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = float(MOST_ROUNDS * sizes[s])
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return out


def whole_totals(want: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whole numbers near ``want`` with its sum, rounded, none over ``most`` (where that can be)."""
    out = np.minimum(np.floor(want + 1e-9).astype(np.int64), most)
    left = int(round(float(want.sum()))) - int(out.sum())
    for k in np.argsort(-(want - out), kind="stable"):
        step = min(1, left, int(most[k] - out[k]))
        out[k] += step
        left -= step
    return out


def half(counts: np.ndarray, slots: int, seed: list[int]) -> np.ndarray:
    """How many of ``slots`` slots each source gets, of ``counts`` in all."""
    rng, total = np.random.Generator(np.random.PCG64(seed)), int(counts.sum())
    if total <= DRAWN_MOST:
        return rng.multivariate_hypergeometric(counts, slots, method="marginals")
    share = counts / total * slots
    out = np.floor(share).astype(np.int64)
    rest = share - out
    out += rng.multinomial(slots - int(out.sum()), rest / max(rest.sum(), 1e-9)) if slots > out.sum() else 0
    return np.minimum(out, counts)


def shard_counts(totals: np.ndarray, first: int, last: int, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, counts by source) of the shards from ``first`` up to ``last``."""
    slots = int(totals.sum())
    todo = [(0, -(-slots // SHARD_SLOTS), totals)]
    while todo:
        a, b, counts = todo.pop()
        if b <= first or a >= last:
            continue
        if b - a == 1:
            yield a, counts
            continue
        mid = (a + b) // 2
        left = half(counts, (mid - a) * SHARD_SLOTS, [seed, a, b])
        todo += [(mid, b, counts - left), (a, mid, left)]


def feistel(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of range(n) by key, element by element: a Feistel network
    over the next even power of two, walked until it falls below n."""
    half = np.maximum((np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2, 1).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, n, key = index.astype(np.uint64), n.astype(np.uint64), key.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        a, b, m, h, k = x[todo] >> half[todo], x[todo] & mask[todo], mask[todo], half[todo], key[todo]
        for r in range(4):
            f = (b + k + np.uint64(r)) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ f >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ (f >> np.uint64(32)) & m
        x[todo] = a << h | b
        todo[todo] = x[todo] >= n[todo]
    return x.astype(np.int64)


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, row_col: str | None = None) -> DataFrame:
    """(row, doc_id, source, size, hash, bucket): a number of its own for every row, its
    words, and its place in the order of a hash of its id."""
    n = docs.count()
    bits = min(13, max(0, int(np.ceil(np.log2(max(1, n / BUCKET_ROWS))))))
    h = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return docs.select(
        (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), h.alias("hash"), (F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")).alias("bucket"),
    )


def source_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(src, source, source_size, target, blocks).  From an Arrow table, as rows of Python
    objects would go through Python workers of another kind, which stay beside the usual ones."""
    types = {"src": pa.int32(), "source": pa.string(), "source_size": pa.int64(), "target": pa.float64(), "blocks": pa.int64()}
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    return spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], names=list(types)))


def plan(rows: DataFrame, seed: int = 1, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """From ``measured`` rows: (rows with source_size, target and start in their source's
    stream; (src, block, times): how often the mix takes each block).

    The driver holds one number per source.
    """
    spark = rows.sparkSession
    sizes = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    goal = targets(sizes)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    table = [(k, s, int(sizes[s]), float(goal[s]), int(-(-sizes[s] // block_words))) for k, s in enumerate(order)]
    sources = source_table(spark, table)
    rows = rows.join(F.broadcast(sources), rows["source"].eqNullSafe(sources["source"])).drop("source")
    rows = running_total(rows, ["src"], "bucket", ["hash", "doc_id", "size", "row"], "size", "start")
    # a block counts as its average length, so that a short last block costs no words
    per_block = np.array([t[2] / t[4] if t[4] else 1.0 for t in table])
    want = np.array([t[3] for t in table]) / np.maximum(per_block, 1e-9)
    blocks_of = np.array([t[4] for t in table], np.int64)
    totals = whole_totals(want, MOST_ROUNDS * blocks_of)
    shards = -(-int(totals.sum()) // SHARD_SLOTS)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, counts in shard_counts(totals, int(batch["id"].min()), int(batch["id"].max()) + 1, seed) if len(batch) else ():
                yield pd.DataFrame({"shard": shard, "src": np.arange(len(counts), dtype=np.int32), "n": counts})

    drawn = written(spark.range(shards).mapInPandas(draw, "shard long, src int, n long").filter("n > 0"), "draws")
    drawn = running_total(drawn.withColumn("bucket", F.expr(f"shard div {SHARD_BUCKET}")), ["src"], "bucket", ["shard"], "n", "first")

    def slot_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for src, first, n in zip(batch["src"], batch["first"], batch["n"], strict=True):
                j = np.arange(first, first + n)
                size = np.full(len(j), blocks_of[src])
                key = (j // size).astype(np.uint64) + np.uint64(seed * 1_000_003 + src * 101)
                block, times = np.unique(feistel(j % size, size, key * np.uint64(0x94D049BB133111EB)), return_counts=True)
                yield pd.DataFrame({"src": np.full(len(block), src, np.int32), "block": block, "times": times})

    # a few bytes a draw become thousands of slots, so draws are dealt out first
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    taken = drawn.select("src", "first", "n").repartition(parts, "src", "first").mapInPandas(slot_blocks, "src int, block long, times long")
    return rows, taken.groupBy("src", "block").agg(F.sum("times").alias("times"))


def pieces(rows: DataFrame, taken: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(row, at, n, times): the part of a row's words, from word ``at``, in each taken block."""
    end = F.col("start") + F.col("size")
    cut = rows.filter("size > 0").select("row", "src", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words))).alias("block"))
    low, high = F.greatest("start", F.col("block") * block_words), F.least(end, (F.col("block") + 1) * block_words)
    return cut.select("row", "src", "block", (low - F.col("start")).alias("at"), (high - low).alias("n")).join(taken.hint("merge"), ["src", "block"]).select("row", "at", "n", "times")


def mix(docs: DataFrame, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row.

    Null texts count as empty and are taken 0 times; null sources are one source, last in
    order; every repeated row counts.  Runs over the same files agree, as draws and
    permutations depend on the seed and the order on ids alone.  An empty table gives no rows.
    """
    rows, taken = plan(written(measured(docs, id_col, text_col, source_col), "sizes"), seed)
    rows = written(rows.select("row", "doc_id", "src", "size", "source_size", "target", "start"), "starts")
    words = pieces(rows, taken).groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("taken"))
    return rows.join(words, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus itself, with the columns of ``docs``: a row for each time that words
    of a document are taken, its text the words taken so often, in their order and with the
    white space between them.  A document taken whole keeps its text as it is.

    Rows without words are taken 0 times and go; null sources are one source; repeated rows
    each count; columns of any names come through; an empty table gives no rows."""
    bound_batches(docs)
    row, pieces_, copy = inner_names(docs, 3)
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    sizes = written(measured(numbered, id_col, text_col, source_col, row), "sizes")
    rows, taken = plan(sizes, seed)
    got = pieces(rows, taken).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "n", "times"))).alias(pieces_))
    joined = numbered.join(got.withColumnRenamed("row", row), row)
    out = joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.array_max(F.col(pieces_)["times"]).cast("int"))))

    @F.pandas_udf("string")
    def taken_text(texts: pd.Series, parts: pd.Series, copies: pd.Series) -> pd.Series:
        import re

        find = re.compile(WORD).finditer
        result = []
        for text, part, copy in zip(texts, parts, copies, strict=True):
            spans = [(p["at"], p["at"] + p["n"]) for p in part if p["times"] >= copy]
            words = [m.span() for m in find(text)]
            if spans and spans[0][0] == 0 and spans[-1][1] == len(words) and sum(b - a for a, b in spans) == len(words):
                result.append(text)
                continue
            joined, runs = [], []
            for a, b in spans:
                if runs and runs[-1][1] == a:
                    runs[-1][1] = b
                else:
                    runs.append([a, b])
            for a, b in runs:
                joined.append(text[words[a][0] : words[b - 1][1]])
            result.append("\n".join(joined))
        return pd.Series(result)

    return out.withColumn(text_col, taken_text(text_col, pieces_, copy)).select(*docs.columns)
