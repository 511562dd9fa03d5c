"""Quality classifier by compression.

Two zstandard dictionaries are built, from good and from bad labelled texts.  A text is
cut into blocks, every block is compressed with either dictionary, and the difference of
the summed sizes over the plain size, the normalised compressed-size difference, goes through
a logistic curve fitted on other labelled texts, beside the mean of the two sizes, without
which a text that only repeats itself would pass for a neutral one.  Blocks keep a long text from being
compressed by its own past alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.shared import bound_batches, worker_state

#: Labelled texts of each class that a fit takes at most: those of the smallest hashes.
#: The bound keeps the driver's share of the corpus fixed.
SAMPLE_PER_CLASS = 1500
#: Blocks of one text that a dictionary learns from, drawn from all of its blocks.
SAMPLE_BLOCKS = 16
DICT_BYTES = 65536
BLOCK_BYTES = 1024
LEVEL = 1


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def _blocks(raw: bytes) -> list[bytes]:
    return [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]


def _drawn(raw: bytes) -> bytes:
    """A text's blocks in order, or ``SAMPLE_BLOCKS`` of them drawn by its hash."""
    blocks = _blocks(raw)
    if len(blocks) <= SAMPLE_BLOCKS:
        return raw
    chosen = np.random.default_rng(zlib.crc32(raw)).choice(len(blocks), SAMPLE_BLOCKS, replace=False)
    # the last block may be short: in order, it leaves the others whole
    return b"".join(blocks[k] for k in np.sort(chosen))


def train_dictionary(texts: list[bytes]) -> bytes:
    """A zstandard dictionary of the texts' blocks; the blocks themselves, up to its size,
    where there are too few to train one."""
    samples = [b for t in texts for b in _blocks(t)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICT_BYTES]


class Compressors:
    def __init__(self, good: bytes, bad: bytes):
        self.pair = [zstandard.ZstdCompressor(level=LEVEL, dict_data=self._dict(d), write_content_size=False, write_dict_id=False) for d in (good, bad)]

    @staticmethod
    def _dict(raw: bytes):
        d = zstandard.ZstdCompressionDict(raw if len(raw) >= 8 else raw.ljust(8, b"\0"))
        d.precompute_compress(level=LEVEL)
        return d

    def measures(self, raw: bytes) -> tuple[float, float]:
        """Difference (bad - good) and mean of the compressed sizes over the plain size;
        0 and 1 for an empty text."""
        blocks = _blocks(raw)
        if not blocks:
            return 0.0, 1.0
        good, bad = (sum([len(c.compress(b)) for b in blocks]) for c in self.pair)
        return (bad - good) / len(raw), (bad + good) / 2 / len(raw)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> list[float]:
    """Slopes and, last, the offset of a weighted logistic curve, by Newton's method."""
    w = np.zeros(x.shape[1] + 1)
    if len(x) == 0 or y.min() == y.max():
        w[-1] = 0.0 if len(x) == 0 else 4.0 if y.min() == 1 else -4.0
        return w.tolist()
    a = np.column_stack([x, np.ones(len(x))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weight * (p - y)) + ridge * w
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def squash(x: np.ndarray, center: list[float], spread: list[float]) -> np.ndarray:
    """Each measure's distance from its median among good texts in robust deviations, held
    within 8 so that far ends don't decide the curve."""
    return np.clip((x - np.array(center)) / np.array(spread), -8, 8)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> dict:
    """The model: dictionaries, scales and curve.

    It learns only from labelled rows outside the held-out fold, at most
    ``SAMPLE_PER_CLASS`` a class.  Half of them build the dictionaries, from at most
    ``SAMPLE_BLOCKS`` blocks a text; the other half, measured whole where they lie, fit the
    curve, weighted to the classes' true shares.  Without labels every score is 0.5;
    with one class only, every score leans to it.
    """
    bound_batches(docs)
    known = labels.filter(F.col(label_col).isin(0, 1) & (fold(id_col) != 0)).groupBy(id_col).agg(F.max(label_col).alias("_y"))
    shares = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    by_hash = F.xxhash64(F.col(id_col))
    chosen = [known.filter(F.col("_y") == y).orderBy(by_hash, id_col).limit(SAMPLE_PER_CLASS) for y in (0, 1)]
    place = F.row_number().over(Window.partitionBy("_y").orderBy(by_hash, id_col))  # SAMPLE_PER_CLASS rows a class
    ids = F.broadcast(chosen[0].unionByName(chosen[1]).withColumn("_curve", place % 2 == 0))
    rows = docs.select(id_col, F.col(text_col).alias("_t")).join(ids, id_col).select("_y", "_curve", by_hash.alias("_h"), F.encode(F.coalesce("_t", F.lit("")), "UTF-8").alias("_t"))

    @F.pandas_udf("binary")
    def drawn(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _drawn(bytes(t)))

    got = sorted((r["_h"], r["_y"], bytes(r["_t"])) for r in rows.filter(~F.col("_curve")).select("_h", "_y", drawn("_t").alias("_t")).collect())
    texts = {y: [t for _, c, t in got if c == y] for y in (0, 1)}
    dicts = {y: train_dictionary(texts[y]) for y in (0, 1)}

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        pair = Compressors(dicts[1], dicts[0])
        return texts.map(lambda t: list(pair.measures(bytes(t))))

    def numbers(part: DataFrame) -> list:
        return sorted((r["_y"], r["_h"], *r["_m"]) for r in part.select("_y", "_h", measured("_t").alias("_m")).collect())

    curve_rows = numbers(rows.filter("_curve"))
    lone = [y for y in (0, 1) if texts[y] and all(r[0] != y for r in curve_rows)]
    if lone:  # a single text is its class's dictionary and its measure
        curve_rows = sorted(curve_rows + numbers(rows.filter(~F.col("_curve") & F.col("_y").isin(lone))))
    if not curve_rows:
        return {"good": b"", "bad": b"", "center": [0.0, 0.0], "spread": [1.0, 1.0], "curve": [0.0, 0.0, 0.0]}
    x = np.array([r[2:] for r in curve_rows])
    y = np.array([r[0] for r in curve_rows], float)
    count = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    weight = np.array([shares.get(int(c), 0) / count[int(c)] for c in y])
    weight *= len(weight) / max(weight.sum(), 1e-9)
    usual = x[y == 1] if (y == 1).any() else x
    center = np.median(usual, 0)
    spread = np.maximum(1.4826 * np.median(np.abs(usual - center), 0), 1e-6)
    curve = fit_logistic(squash(x, center, spread), y, weight)
    return {"good": dicts[1], "bad": dicts[0], "center": center.tolist(), "spread": spread.tolist(), "curve": curve}


def score(text: Column, model: dict) -> Column:
    """A column of scores from 0 to 1, higher where label 1 is likelier.  Null texts count
    as empty; their size difference is 0, their mean 1."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        state = worker_state("quality")
        key = hash((model["good"], model["bad"]))
        if key not in state:
            state[key] = Compressors(model["good"], model["bad"])
        pair = state[key]
        for texts in batches:
            x = np.array([pair.measures((t or "").encode("utf-8", "replace")) for t in texts]).reshape(-1, 2)
            z = squash(x, model["center"], model["spread"]) @ np.array(model["curve"][:2]) + model["curve"][2]
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return run(text)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, score, predicted) of every row; repeated rows repeat, a null id
    is not held out, other columns are ignored."""
    model = fit(docs, labels, id_col, text_col)
    scored = docs.select(id_col, F.coalesce(fold(id_col) == 0, F.lit(False)).alias("held_out"), score(F.col(text_col), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
