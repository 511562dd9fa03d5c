"""The object graph of documents as relations, and garbage collection on it.

``objects``: (doc_id, num, kind, body, is_stream); ``refs``: (doc_id, num, target).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of objects that are never merged.
KEPT_APART = ("Page", "Pages", "Catalog", "Annot", "Widget", "ObjStm", "XRef")


def overlay(objects: DataFrame, changes: DataFrame) -> DataFrame:
    """Effective objects: ``changes`` (doc_id, num, kind, body, is_stream, deleted) win."""
    c = changes.select("doc_id", "num", F.struct("kind", "body", "is_stream").alias("_new"), F.col("deleted").alias("_gone"), F.lit(True).alias("_set"))
    out = objects.join(c, ["doc_id", "num"], "full_outer").filter(~F.coalesce("_gone", F.lit(False)))
    pick = lambda n: F.when(F.col("_set"), F.col(f"_new.{n}")).otherwise(F.col(n)).alias(n)
    return out.select("doc_id", "num", pick("kind"), pick("body"), pick("is_stream"))


def newest(entries: DataFrame) -> DataFrame:
    """Of revisions (doc_id, num, rev, ...) the latest row of each object."""
    w = Window.partitionBy("doc_id", "num").orderBy(F.col("rev").desc())
    return entries.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def add(objects: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` (doc_id, kind, body, is_stream) with the numbers after the largest."""
    top = objects.groupBy("doc_id").agg(F.max("num").alias("_top"))
    numbered = new.join(top, "doc_id", "left").withColumn("num", (F.coalesce("_top", F.lit(0)) + F.row_number().over(Window.partitionBy("doc_id").orderBy("kind", "body"))).cast("long"))
    return objects.unionByName(numbered.drop("_top"))


def dereference(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """(doc_id, num, target, kind, body): null where the target doesn't exist."""
    t = objects.select("doc_id", F.col("num").alias("target"), "kind", "body")
    return refs.join(t, ["doc_id", "target"], "left").select("doc_id", "num", "target", "kind", "body")


def reachable(roots: DataFrame, refs: DataFrame) -> DataFrame:
    """(doc_id, num) that references lead to from ``roots`` (doc_id, num), themselves included.

    Breadth first; every step joins only the newly found objects, and their lineage is cut
    by a checkpoint in the session's shared folder.
    """
    spark = roots.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        import tempfile

        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="quire-"))
    seen = front = roots.select("doc_id", "num").distinct().checkpoint()
    while not front.isEmpty():
        step = front.join(refs, ["doc_id", "num"]).select("doc_id", F.col("target").alias("num")).distinct()
        front = step.join(seen, ["doc_id", "num"], "left_anti").checkpoint()
        seen = seen.unionByName(front).checkpoint()
    return seen


def mark_sweep(objects: DataFrame, refs: DataFrame, roots: DataFrame) -> DataFrame:
    return objects.join(reachable(roots, refs), ["doc_id", "num"], "left_semi")


def dedup_map(objects: DataFrame, streams: bool = False) -> DataFrame:
    """(doc_id, num, keep): the smallest object of equal kind and body, in one pass.  Streams
    merge only if asked for, the kinds of ``KEPT_APART`` never."""
    may = ~F.col("kind").isin(*KEPT_APART) & (~F.col("is_stream") | F.lit(streams))
    key = F.when(may, F.sha2(F.concat_ws("\0", "kind", F.col("is_stream").cast("string"), "body"), 256)).otherwise(F.concat(F.lit("own "), F.col("num").cast("string")))
    # an aggregate and a join instead of a window: equal objects may be very many
    keyed = objects.select("doc_id", "num", key.alias("_key"))
    return keyed.join(keyed.groupBy("doc_id", "_key").agg(F.min("num").alias("keep")), ["doc_id", "_key"]).select("doc_id", "num", "keep")


def renumber_map(objects: DataFrame) -> DataFrame:
    """(doc_id, num, new): dense numbers from 1 in the order of the old ones."""
    w = Window.partitionBy("doc_id").orderBy("num")
    return objects.select("doc_id", "num", F.row_number().over(w).cast("long").alias("new"))


def collect(objects: DataFrame, refs: DataFrame, roots: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """Objects and references after garbage collection: 1 drops what isn't reached, 2 also
    renumbers, 3 merges equal objects first, 4 streams too."""
    if level >= 1:
        objects = mark_sweep(objects, refs, roots)
        refs = refs.join(objects, ["doc_id", "num"], "left_semi")
    if level >= 3:
        same = dedup_map(objects, level >= 4)
        objects = objects.join(same.filter("num = keep"), ["doc_id", "num"], "left_semi")
        refs = refs.join(same.filter("num = keep").select("doc_id", "num"), ["doc_id", "num"], "left_semi")
        to = same.select("doc_id", F.col("num").alias("target"), F.col("keep").alias("_t"))
        refs = refs.join(to, ["doc_id", "target"], "left").select("doc_id", "num", F.coalesce("_t", "target").alias("target"))
    if level >= 2:
        new = renumber_map(objects)
        objects = objects.join(new, ["doc_id", "num"]).withColumn("num", F.col("new")).drop("new")
        refs = refs.join(new, ["doc_id", "num"]).select("doc_id", F.col("new").alias("num"), "target")
        refs = refs.join(new.withColumnRenamed("num", "target"), ["doc_id", "target"]).select("doc_id", "num", F.col("new").alias("target"))
    return objects, refs
