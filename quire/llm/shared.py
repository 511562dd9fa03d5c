"""Helpers that several operators share: written intermediate tables, running totals
over an ordered corpus, and state that outlives a task inside a Python worker."""

from __future__ import annotations

import atexit
import ctypes
import gc
import json
import re
import sys
import tempfile
import types
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one ordered bucket holds on average; a bucket is sorted by one task.
BUCKET_ROWS = 2048
MOST_BUCKETS = 8192
#: Keys of a bucket from which bounds are found, on average.
BUCKET_SAMPLE = 32
#: Bytes of an Arrow batch on its way to a Python worker.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it; a temporary folder stands in where that setting is
    absent and everything runs on one machine, as in tests.  A cluster without it raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='quire-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quire-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex[:12]}-{tag}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    try:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended already; its folder then goes with it
        pass


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and read again from files
    whatever executor is lost later."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def worker_state(owner: str) -> dict:
    """A dictionary that lives as long as the Python worker, until another owner asks (tasks
    unpickle their functions anew, so module globals would not last).  A worker that has
    gone over to another operator doesn't keep the caches of the one before."""
    held = sys.modules.setdefault("_quire_worker_state", types.ModuleType("_quire_worker_state")).__dict__
    if held.get("owner") != owner:
        held["owner"], held["state"] = owner, {}
        gc.collect()
        trim()
    return held["state"]


def bound_batches(df: DataFrame) -> None:
    """Bounds the Arrow batches of the session of ``df`` by ``BATCH_BYTES``, unless it has a
    bound of its own: batches of so many rows, of long texts, would take hundreds of MB in a
    worker and as much again beside the JVM's heap."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(name, None) is None:
        df.sparkSession.conf.set(name, str(BATCH_BYTES))


def trim() -> None:
    """Gives what the Python worker has freed back to the system, as far as its allocators can."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


KEY = "array<struct<known:boolean,id:bigint,tie:bigint,row:bigint>>"


def order_key(id_col: str, tie: Column) -> Column:
    """The place of a row in ascending order of an integer id, null ids first, and then of
    ``tie``, a long; rows alike in both are told apart by a number of their own."""
    row_id = F.col(id_col).cast("long")
    return F.struct(row_id.isNotNull().alias("known"), F.coalesce(row_id, F.lit(0)).alias("id"), tie.alias("tie"), F.monotonically_increasing_id().alias("row"))


def order_buckets(df: DataFrame, key: Column) -> tuple[list, Column]:
    """Bounds that cut the rows into ranges of ``key`` (of ``order_key``) of about
    ``BUCKET_ROWS`` rows each, or a ``MOST_BUCKETS``th of them where that is more, whatever
    the ids; and the literal of the bounds for ``bucket_of``.

    The bounds are quantiles of a sample of the keys, of ``BUCKET_SAMPLE`` rows a bucket:
    only these reach the driver.
    """
    n = df.count()
    buckets = min(MOST_BUCKETS, -(-n // BUCKET_ROWS))
    bounds: list = []
    if buckets > 1:
        every = max(1, n // (buckets * BUCKET_SAMPLE))
        rows = df.select(key.alias("key")).filter(F.pmod(F.xxhash64("key.row"), F.lit(every)) == 0)
        sample = sorted(tuple(r["key"]) for r in rows.collect())
        bounds = sorted({sample[k * len(sample) // buckets] for k in range(1, buckets)}) if sample else []
    names = ("known", "id", "tie", "row")
    return bounds, F.from_json(F.lit(json.dumps([dict(zip(names, b, strict=True)) for b in bounds])), KEY)


def bucket_of(key: Column, bounds: tuple[list, Column]) -> Column:
    """The number of bounds at or before ``key``, by bisection."""
    some, literal = bounds
    if not some:
        return F.lit(0)
    steps = F.array(*(F.lit(1 << k) for k in range(len(some).bit_length() - 1, -1, -1)))
    past = lambda at: (at <= len(some)) & (F.try_element_at(literal, at) <= key)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(past(at + step), at + step).otherwise(at))


def running_total(df: DataFrame, group: list[str], bucket: str, order: list, value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows of the same group before this one,
    in the order (bucket, *order).  Buckets are summed first and their totals accumulated,
    so that no task sorts more than one bucket, or more totals than there are buckets."""
    totals = df.groupBy(*group, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, bucket, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(totals, [*group, bucket])
        .withColumn(out, (F.col("_base") + F.coalesce(F.sum(value).over(within), F.lit(0))).cast("long"))
        .drop("_base")
    )


def inner_names(df: DataFrame, n: int) -> list[str]:
    """``n`` column names that ``df`` doesn't have, in any case."""
    taken, out, k = {c.lower() for c in df.columns}, [], 0
    while len(out) < n:
        if (name := f"_q{k}") not in taken:
            out.append(name)
        k += 1
    return out
