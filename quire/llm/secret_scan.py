"""Secret scan with corpus-wide ownership frequency, in DataFrame functions alone.

Spans of three base kinds (assigned values, access keys, hexadecimal strings) and bare
credential-looking strings are found in every text.  Each candidate's value is hashed and
the hashes are aggregated over the corpus by the distinct repositories and owners that
hold them: what many owners or very many repositories hold is a copied example, what few
hold looks live.  Base spans always stay; a bare string becomes a span only where it looks live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.spans import apart, bound, listed, matches, of_kind
from quire.llm.shared import written

ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
#: A bare string of base64 or URL-safe characters; it must mix cases and digits to count.
BARE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}"
KINDS = ("assign", "access", "hex", "bare")
#: Held by so many owners at least, or so many repositories, a value is a copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 100

SPANS = "array<struct<ord:int,kind:string,start:bigint,end:bigint,m:string>>"


def _assigned_value(m: Column) -> Column:
    return F.regexp_extract(m, ASSIGN, 2)


def candidates(text: Column) -> Column:
    """All spans of one text as ``SPANS``, with a match's text in ``m``."""
    assign = F.filter(matches(text, ASSIGN), lambda s: F.char_length(_assigned_value(s["m"])) >= 8)
    access = F.filter(matches(text, ACCESS, F.contains(text, F.lit("AKIA"))), lambda s: F.char_length(s["m"]) >= 16)
    hexes = matches(text, HEX)
    mixed = lambda s: s["m"].rlike("[a-z]") & s["m"].rlike("[A-Z]") & s["m"].rlike("[0-9]")
    bare = F.filter(matches(text, BARE), mixed)
    found = {"assign": assign, "access": access, "hex": hexes, "bare": bare}

    def all_of(v):
        base = [of_kind(v[k], k, i) for i, k in enumerate(KINDS[:3])]
        return F.concat(*base, of_kind(apart(v["bare"], v["assign"], v["access"], v["hex"]), "bare", 3))

    return bound(found, all_of).cast(SPANS)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str | None = None, owner_col: str = "source") -> DataFrame:
    """One row per document: (doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_bare,
    n_live, n_example).

    ``n_example`` counts its spans whose value at least ``EXAMPLE_OWNERS`` owners or
    ``EXAMPLE_REPOSITORIES`` repositories hold, ``n_live`` all others.  A document is its own repository unless a
    column names one.  A null owner is one owner; a null text counts as empty; repeated
    rows each count as a document; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(owner_col).cast("string"), F.lit("\0")).alias("owner"), (F.col(repository_col).cast("string") if repository_col else F.lit(None).cast("string")).alias("repository"), candidates(text).alias("found"))
    value = lambda s: F.when(s["kind"] == "assign", _assigned_value(s["m"])).otherwise(s["m"])
    rows = written(rows.withColumn("found", F.transform("found", lambda s: F.struct(s["ord"].alias("ord"), s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.sha2(value(s).cast("binary"), 256).alias("hash")))), "secret-candidates")
    held = rows.filter(F.size("found") > 0).select("row", "owner", F.coalesce("repository", F.col("row").cast("string")).alias("repository"), F.explode("found").alias("s"))
    # distinct (hash, owner) rows and counts shrink before any shuffle of a hot hash
    by_owner = held.select("s.hash", "owner", "repository").distinct().groupBy("hash", "owner").agg(F.count("*").alias("n_repositories"))
    owned = by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n_repositories").alias("n_repositories"))
    judged = held.select("row", "s.*").join(owned, "hash")
    example = (F.col("n_owners") >= EXAMPLE_OWNERS) | (F.col("n_repositories") >= EXAMPLE_REPOSITORIES)
    kept = (F.col("ord") < 3) | ~example
    spans = judged.filter(kept).groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "ord", "end", "kind"))).alias("all"),
        F.count_if(~example).alias("n_live"),
        F.count_if(example).alias("n_example"),
    )
    none = F.array().cast("array<struct<start:bigint,ord:int,end:bigint,kind:string>>")
    out = rows.select("doc_id", "row").join(spans, "row", "left").withColumn("all", F.coalesce("all", none))
    base = F.filter("all", lambda s: s["ord"] < 3)
    count = lambda kind: F.size(F.filter("all", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"), count("bare"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_live", "n_example")))
