"""Document fingerprints: homomorphic multiset hashes, in DataFrame functions alone.

A text is a multiset of paragraphs (its lines).  Every paragraph hashes to a wide vector
and the fingerprint is the sum of the vectors, lane by lane, modulo powers of two:

* ``whole``: ``WHOLE_LANES`` lanes modulo 2**32 of each paragraph, for equality.  The
  order of paragraphs doesn't matter, and a paragraph can be added or taken away later.
* ``parts``: ``PART_LANES`` lanes of the runs of a few words that a paragraph is cut into,
  where a run adds a heavy-tailed signed number of its hash, times its characters, to every
  lane; ``n_parts`` counts the characters.  A lane of the difference of two fingerprints is
  about Cauchy with the sum of characters x |difference of a run's counts| for its scale:
  a run weighs by its length, and one repeated often by its repeats and not their square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.shared import bucket_of, order_buckets, order_key, written

WHOLE_LANES = 16
MASK32 = 0xFFFFFFFF
#: Lanes of word runs; the distance they give errs by sqrt(2 / PART_LANES) of itself.
PART_LANES = 64
#: A run ends with the first word from 16 characters on that ends in one of about half of
#: all letters, so that an edit moves no ends but those beside it, or within 47 characters.
#: In scripts without spaces some blocks of characters end a run.
RUNS = r"\S[^\n]{15,46}?(?:[.!?,;:aegikoqstxz](?!\S)|[、。぀-ゟ一-埿])|\S[^\n]{0,46}"
#: A run's number in a lane is its length << TOP_BITS over an odd number of ODD_BITS bits of
#: a hash; the length is kept in the low bits of the run's first hash.
TOP_BITS, ODD_BITS, LENGTH_MASK = 38, 36, 63
#: Scale of the Cauchy lanes of one character: pi / 2 times the least of these numbers.
SCALE = 3.141592653589793 / 2 * (1 << TOP_BITS - ODD_BITS + 1)
#: What the estimate of a distance exceeds it by, in characters, as few such numbers aren't
#: quite Cauchy; for a single run it is the ratio.
EXCESS, SINGLE = 8, 0.69


def _sum(values: Column, term) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + term(x))


def _lane(k: int):
    odd = lambda x: F.shiftright(F.xxhash64(x, F.lit(k)), 64 - ODD_BITS).bitwiseOR(F.lit(1))
    return lambda x: F.call_function("div", F.shiftleft(x.bitwiseAND(F.lit(LENGTH_MASK)), TOP_BITS), odd(x))


def with_fingerprint(df: DataFrame, text_col: str, out: str = "fingerprint") -> DataFrame:
    """Adds struct(whole array<long>, n_parts long, parts array<long>); a null text counts
    as empty.  The arrays of hashes are columns of their own on the way, so that a text is
    cut once and not once a lane."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    length = lambda s: F.char_length(s).cast("long")
    hashed = F.transform(F.regexp_extract_all(text, F.lit(RUNS), F.lit(0)), lambda s: F.xxhash64(s).bitwiseAND(F.lit(~LENGTH_MASK)).bitwiseOR(length(s)))
    df = df.withColumns({"_p": F.transform(F.split(text, "\n", -1), lambda p: F.md5(p.cast("binary"))), "_r": hashed})
    whole = [_sum(F.col("_p"), lambda p, k=k: F.xxhash64(p, F.lit(k)).bitwiseAND(F.lit(MASK32))).bitwiseAND(F.lit(MASK32)) for k in range(WHOLE_LANES)]
    parts = [_sum(F.col("_r"), _lane(k)) for k in range(PART_LANES)]
    df = df.withColumn(out, F.struct(F.array(*whole).alias("whole"), _sum(F.col("_r"), lambda x: x.bitwiseAND(F.lit(LENGTH_MASK))).alias("n_parts"), F.array(*parts).alias("parts")))
    return df.drop("_p", "_r")


def add(a: Column, b: Column) -> Column:
    """Fingerprint of both multisets together: insertion of ``b`` into ``a``."""
    whole = F.zip_with(a["whole"], b["whole"], lambda x, y: (x + y).bitwiseAND(F.lit(MASK32)))
    return F.struct(whole.alias("whole"), (a["n_parts"] + b["n_parts"]).alias("n_parts"), F.zip_with(a["parts"], b["parts"], lambda x, y: x + y).alias("parts"))


def subtract(a: Column, b: Column) -> Column:
    """Fingerprint of ``a`` after deletion of the paragraphs of ``b``."""
    whole = F.zip_with(a["whole"], b["whole"], lambda x, y: (x + F.lit(1 << 32) - y).bitwiseAND(F.lit(MASK32)))
    return F.struct(whole.alias("whole"), (a["n_parts"] - b["n_parts"]).alias("n_parts"), F.zip_with(a["parts"], b["parts"], lambda x, y: x - y).alias("parts"))


def as_text(f: Column) -> Column:
    """A fingerprint as a string of hexadecimal lanes."""
    lanes = lambda name: F.array_join(F.transform(f[name], lambda x: F.hex(x)), ".")
    return F.concat_ws(":", lanes("whole"), F.hex(f["n_parts"]), lanes("parts"))


def _distance(lanes: Column) -> Column:
    """Scale of Cauchy numbers by likelihood: steps of expectation-maximisation from the
    median of their sizes."""
    sizes = F.transform(lanes, lambda x: F.abs(x.cast("double")))
    start = lambda v: F.greatest(F.lit(1e-9), F.element_at(F.array_sort(v), PART_LANES // 2))
    weighed = lambda v, c: F.aggregate(v, F.lit(0.0), lambda s, x: s + 2 * x * x * c * c / (c * c + x * x))
    step = lambda v: lambda c, _: F.greatest(F.lit(1e-9), F.sqrt(weighed(v, c) / PART_LANES))
    # an array of one array gives the sizes a name, else every step would make them anew
    return F.transform(F.array(sizes), lambda v: F.aggregate(F.array(*map(F.lit, range(4))), start(v), step(v)))[0]


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1: the share of the texts' characters in word runs that both have, repeats
    counted, estimated from their fingerprints; 1 for equal ones and 0 where just one text is empty."""
    apart = _distance(F.zip_with(a["parts"], b["parts"], lambda x, y: x - y)) / SCALE
    apart = F.greatest(apart - EXCESS, apart * SINGLE)
    estimate = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - apart / F.greatest(a["n_parts"] + b["n_parts"], F.lit(1))))
    same = (a["whole"] == b["whole"]) & (a["parts"] == b["parts"])
    return F.when(same, F.lit(1.0)).when((a["n_parts"] == 0) | (b["n_parts"] == 0), F.lit(0.0)).otherwise(estimate)


def with_next(docs: DataFrame, carried: list[str], id_col: str, tie_col: str) -> DataFrame:
    """Adds ``next_<c>`` for each carried column: the value of the row that follows in
    ascending order of id and tie (a long), null ids first, and of the first row for the
    last one.

    Rows are dealt to ranges of that order; the first row of each range also visits the
    range before it, so that one shuffle brings every row together with its successor.
    """
    key = order_key(id_col, F.col(tie_col))
    rows = docs.withColumn("_k", key).withColumn("_b", bucket_of(F.col("_k"), order_buckets(docs, key)))
    place = F.struct("_k.known", "_k.id", "_k.tie")
    firsts = rows.groupBy("_b").agg(F.min(place).alias("_first"))
    around = Window.orderBy("_b")  # MOST_BUCKETS rows at most
    firsts = firsts.withColumn("_before", F.coalesce(F.lag("_b").over(around), F.max("_b").over(Window.partitionBy(F.lit(0)))))
    firsts = written(firsts, "first-ids")
    rows = rows.join(F.broadcast(firsts), "_b")
    own, visit = F.struct(F.col("_b").alias("g"), F.lit(False).alias("v")), F.struct(F.col("_before").alias("g"), F.lit(True).alias("v"))
    rows = rows.withColumn("_at", F.explode(F.when(place == F.col("_first"), F.array(own, visit)).otherwise(F.array(own))))
    # flat columns and one projection: all leads share one exchange and one sort
    rows = rows.select(*docs.columns, "_k", F.col("_at.g").alias("_g"), F.col("_at.v").alias("_v"))
    w = Window.partitionBy("_g").orderBy("_v", "_k")
    rows = rows.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in carried))
    return rows.filter(~F.col("_v")).drop("_g", "_v", "_k")


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last quarter comes from
    the next document: (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next).

    A null text counts as empty.  Rows of equal id follow each other in the order of their
    texts' hashes (xxhash64), null ids come first, and the row after the last is the first;
    one row alone is its own successor.  Other columns are ignored; an empty table gives no
    rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = with_next(with_fingerprint(rows.withColumn("th", F.xxhash64("text")), "text", "f"), ["text", "f"], "doc_id", "th")
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    rows = rows.withColumn("edited", F.expr("concat(substring(text, 1, int(n_chars - n_chars div 4)), substring(next_text, 1, int(n_chars div 4)))"))
    rows = with_fingerprint(rows.drop("text", "next_text"), "edited", "e").withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("f")).alias("fingerprint"), as_text(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("e")).alias("near_edited"), likeness(F.col("f"), F.col("next_f")).alias("near_next"),
    )
