"""Extraction quality: text scores of hypothesis against reference, and their roll-ups."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.operators import matching
from quire.plans import arrow

#: Most tokens that the order and edit scores look at.
TOKEN_CAP = 50_000


_BLANKS = str.maketrans("\t\n\f\r", "    ")


def token_list(text: str | None) -> list[str]:
    """Lower-case pieces between white space (space, tab, line and form feed, carriage return);
    each letter has its lower case whatever stands beside it."""
    low = (text or "").replace("\u0130", "i").replace("\u03a3", "\u03c3").lower()
    return [t for t in low.translate(_BLANKS).split(" ") if t]


SCORES = "n_hyp long, n_ref long, precision double, recall double, f1 double, jaccard double"


def content_scores(pairs: DataFrame) -> DataFrame:
    """(id, n_hyp, n_ref, precision, recall, f1, jaccard) of ``pairs`` (id, hyp, ref).

    Multiset overlap of tokens, counted where the two texts have met: no token is shuffled.
    Two empty texts score 1.
    """

    def scores(hyp: str | None, ref: str | None) -> tuple:
        h, r = Counter(token_list(hyp)), Counter(token_list(ref))
        n_hyp, n_ref = h.total(), r.total()
        if not n_hyp and not n_ref:
            return 0, 0, 1.0, 1.0, 1.0, 1.0
        if len(h) > len(r):
            common = [(c, h[t]) for t, c in r.items() if t in h]
        else:
            common = [(c, r[t]) for t, c in h.items() if t in r]
        both = sum(map(min, common))
        ratio = lambda a, b: a / b if b else 0.0
        return n_hyp, n_ref, ratio(both, n_hyp), ratio(both, n_ref), 2 * both / (n_hyp + n_ref), len(common) / (len(h) + len(r) - len(common))

    schema = StructType([pairs.schema["id"], *StructType.fromDDL(SCORES).fields])
    kinds = [pa.int64()] * 2 + [pa.float64()] * 4

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        columns = zip(*(scores(h.as_py(), r.as_py()) for h, r in zip(batch.column("hyp"), batch.column("ref"), strict=True)), strict=True)
        made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
        if made:
            yield arrow.batch(dict(zip(schema.names, [batch.column("id"), *made], strict=True)))

    return arrow.mapped(pairs.select("id", "hyp", "ref"), run, schema)


def word_jaccard(a: Column, b: Column) -> Column:
    """Share of common words of letters, digits and underscores, lower case."""
    words = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(r"(?U)\w+"), F.lit(0)))
    wa, wb = words(a), words(b)
    all_ = F.size(F.array_union(wa, wb))
    return F.when(all_ == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(wa, wb)) / all_)


def sequence_scores(hyp: Column, ref: Column, cap: int | None = None) -> Column:
    """struct(lev, order_score): the matcher's ratio over the tokens, and the share of the
    common multiset that stands in matching order; both 1 where nothing can be compared.
    ``cap`` bounds the tokens looked at, as the reference does with ``TOKEN_CAP``."""

    @F.pandas_udf("lev double, order_score double")
    def run(hyps: pd.Series, refs: pd.Series) -> pd.DataFrame:
        number: dict[str, int] = {}
        sides = []
        for texts in (hyps, refs):
            tokens = [(t or "").lower().split()[:cap] for t in texts]
            ends = np.append(0, np.cumsum([len(t) for t in tokens])).astype(np.int64)
            sides.append((np.array([number.setdefault(w, len(number)) for t in tokens for w in t], np.int64), ends))
        (a, a_ends), (b, b_ends) = sides
        n = np.diff(a_ends) + np.diff(b_ends)
        found = matching.matched(a, a_ends, b, b_ends)
        # the common multiset: of each token of a pair the smaller count
        pair_token = lambda ids, ends: np.unique(np.repeat(np.arange(len(ends) - 1), np.diff(ends)) * max(len(number), 1) + ids, return_counts=True)
        (ka, ca), (kb, cb) = pair_token(a, a_ends), pair_token(b, b_ends)
        keys, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
        shared = np.bincount(keys // max(len(number), 1), np.minimum(ca[ia], cb[ib]), len(n))
        return pd.DataFrame({"lev": np.where(n > 0, 2.0 * found / np.maximum(n, 1), 1.0), "order_score": np.where(shared > 0, np.minimum(1.0, found / np.maximum(shared, 1)), 1.0)})

    return run(hyp, ref)


def char_accuracy(hyp: Column, ref: Column) -> Column:
    n = F.char_length(ref)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.levenshtein(hyp, ref) / n))


def divergence(lev: Column, jaccard: Column, n_hyp: Column, n_ref: Column) -> Column:
    """A reason by rule, from the plainest on."""
    return (
        F.when((n_hyp == 0) & (n_ref > 0), "empty-output")
        .when((n_ref == 0) & (n_hyp > 0), "empty-reference")
        .when(lev >= 0.98, "match")
        .when((jaccard >= 0.95) & (lev < 0.9), "reading-order")
        .when(n_hyp < 0.7 * n_ref, "missing-text")
        .when(n_hyp > 1.3 * n_ref, "extra-text")
        .otherwise("mixed")
    )


def aggregate(scores: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    aggs = [f(m).alias(f"{n}_{m}") for m in metrics for n, f in (("mean", F.avg), ("median", F.median))]
    return scores.groupBy(by).agg(F.count("*").alias("n"), *aggs)


def head_to_head(scores: DataFrame, metric: str, a: str, b: str) -> DataFrame:
    """Counts of documents that both extractors scored, by who did better."""
    both = scores.filter(F.col("extractor").isin(a, b)).groupBy("id").agg(F.max(F.when(F.col("extractor") == a, F.col(metric))).alias("a"), F.max(F.when(F.col("extractor") == b, F.col(metric))).alias("b")).filter("a is not null and b is not null")
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("a") >= F.col("b")).alias("at_least"), F.count_if(F.col("a") > F.col("b")).alias("wins"), F.count_if(F.col("a") < F.col("b")).alias("losses"))


def worst(scores: DataFrame, metric: str, k: int) -> DataFrame:
    return scores.orderBy(metric, "id").limit(k)


def causes(scores: DataFrame) -> DataFrame:
    """Count and three examples by reason; examples are the smallest ids.  Each of many parts
    of the ids gives its own three first, so no task sorts all ids of a reason."""
    first = lambda ids: F.slice(F.sort_array(ids), 1, 3)
    parts = scores.groupBy("reason", F.pmod(F.xxhash64("id"), F.lit(1024)).alias("_part")).agg(F.count("*").alias("_n"), first(F.collect_list("id")).alias("_ids"))
    examples = F.array_join(F.transform(first(F.flatten(F.collect_list("_ids"))), lambda i: i.cast("string")), ",")
    return parts.groupBy("reason").agg(F.sum("_n").alias("n"), examples.alias("examples"))


def rates(records: DataFrame, by: str, flags: dict[str, Column], value: str, limits: tuple[float, ...]) -> DataFrame:
    """By group: records, how many have each flag and their share, the mean of a value, and
    how many are at or over each limit."""
    counts = [F.count_if(c).alias(f"n_{k}") for k, c in flags.items()] + [F.count_if(F.col(value) >= x).alias(f"from_{x:g}") for x in limits]
    out = records.groupBy(by).agg(F.count("*").alias("n"), *counts, F.avg(value).alias(f"mean_{value}"))
    return out.withColumns({f"{k}_rate": F.col(f"n_{k}") / F.col("n") for k in flags})


def medians_of_runs(runs: DataFrame, by: list[str], item: str, value: str) -> DataFrame:
    """By group: the items, the median of the items' medians over their runs, and the medians' sum."""
    of_item = runs.groupBy(*by, item).agg(F.median(value).alias("_m"))
    return of_item.groupBy(*by).agg(F.count("*").alias("n"), F.median("_m").alias(f"median_{value}"), F.sum("_m").alias(f"sum_{value}"))
