"""Page-set algebra over a relation of pages (doc_id, page_no, ...), and page labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import page_label


def page_range(spec: str, count: int) -> list[int]:
    """0-based pages of a list such as ``1-3,5,-1``; negative numbers count from the end."""
    out: list[int] = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        head, dash, tail = part[1:].partition("-")
        ends = [part[0] + head, tail] if dash else [part]
        try:
            numbers = [int(e) for e in ends]
        except ValueError:
            raise ValueError(f"{part!r} is not a page or range") from None
        a, b = ([n + count if n < 0 else n - 1 for n in numbers] * 2)[:2] if len(numbers) == 1 else [n + count if n < 0 else n - 1 for n in numbers]
        if not (0 <= a < count and 0 <= b < count):
            raise ValueError(f"{part!r} is out of range")
        out += range(a, b + 1) if a <= b else range(a, b - 1, -1)
    return out


def renumbered(pages: DataFrame, *order: Column) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy(*order)
    return pages.withColumn("page_no", (F.row_number().over(w) - 1).cast("int"))


def select(pages: DataFrame, indices: list[int]) -> DataFrame:
    """Pages by a list of indices, in its order and as often as it names them."""
    wanted = F.explode(F.array(*(F.struct(F.lit(i).alias("page_no"), F.lit(k).alias("_to")) for k, i in enumerate(indices))))
    lookup = pages.sparkSession.range(1).select(wanted.alias("w")).select("w.*")
    out = pages.join(F.broadcast(lookup), "page_no")  # one row per index given
    return renumbered(out, F.col("_to")).drop("_to")


def delete(pages: DataFrame, indices: list[int]) -> DataFrame:
    return renumbered(pages.filter(~F.col("page_no").isin(indices)), F.col("page_no"))


def move(pages: DataFrame, source: int, target: int) -> DataFrame:
    """Page ``source`` to stand before page ``target``."""
    place = F.when(F.col("page_no") == source, F.lit(target - 0.5)).otherwise(F.col("page_no").cast("double"))
    return renumbered(pages, place)


def copy(pages: DataFrame, source: int, target: int) -> DataFrame:
    """A second page ``source`` before page ``target``."""
    again = pages.filter(F.col("page_no") == source).withColumn("_at", F.lit(target - 0.5))
    return renumbered(pages.withColumn("_at", F.col("page_no").cast("double")).unionByName(again), F.col("_at")).drop("_at")


def insert_blank(pages: DataFrame, at: int) -> DataFrame:
    """An empty page at an index of every document: other columns are null."""
    blank = pages.select("doc_id").distinct().withColumn("_at", F.lit(at - 0.5))
    return renumbered(pages.withColumn("_at", F.col("page_no").cast("double")).unionByName(blank, allowMissingColumns=True), F.col("_at")).drop("_at")


def append(target: DataFrame, source: DataFrame, start_at: int | None = None, reverse: bool = False) -> DataFrame:
    """Pages of ``source`` put into the documents of the same id of ``target``, at an index
    or at the end."""
    order = -F.col("page_no") if reverse else F.col("page_no")
    at = F.lit(float("inf")) if start_at is None else F.lit(start_at - 0.5)
    both = target.withColumns({"_at": F.col("page_no").cast("double"), "_k": F.lit(0)}).unionByName(source.withColumns({"_at": at, "_k": order}))
    return renumbered(both, F.col("_at"), F.col("_k")).drop("_at", "_k")


def labels(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``pages`` with label: of the last rule (doc_id, startpage, prefix, style,
    firstpagenum) that starts at or before a page; without one, empty.

    An as-of join without a join: rules and pages are one sorted stream per document and
    the last rule is carried on.
    """
    rule = F.struct("startpage", "prefix", "style", "firstpagenum")
    marks = rules.select("doc_id", F.col("startpage").alias("page_no"), F.lit(0).alias("_k"), rule.alias("_r"))
    both = pages.withColumn("_k", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy("doc_id").orderBy("page_no", "_k").rowsBetween(Window.unboundedPreceding, 0)
    r = F.last("_r", ignorenulls=True).over(w)
    out = both.withColumn("_r", r).filter("_k = 1")
    n = F.col("_r.firstpagenum") + F.col("page_no") - F.col("_r.startpage")
    return out.withColumn("label", F.coalesce(page_label(n, F.col("_r.style"), F.col("_r.prefix")), F.lit(""))).drop("_k", "_r")


def pages_by_label(labelled: DataFrame, label: str, only_one: bool = False) -> DataFrame:
    hits = labelled.filter(F.col("label") == label)
    return hits.groupBy("doc_id").agg(F.min("page_no").alias("page_no")) if only_one else hits.select("doc_id", "page_no")
