"""Personal data by weak supervision, in DataFrame functions alone.

Regular expressions propose spans.  For every proposal three labelers vote yes, no or
nothing: the form (digits, check sums, lengths), a gazetteer (known domain endings, name
words, reserved numbers) and the context (words just before).  Expectation-maximisation over the counts
of vote patterns estimates each labeler's reliability and the share of true spans; the
posteriors then train a naive Bayes span classifier on the span's features.  Base spans
always stay; a proposal of another kind becomes a span where the classifier says so.

The driver sees vote patterns and feature values only; both have a fixed number.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import written
from quire.llm.spans import apart, bound, listed, matches, of_kind

# A run of local-part characters is tried from its first one only, or where the match
# before ended; each run is thus read once, and the matches are the plain pattern's.  Labels
# are taken possessively, which changes no match and needs no stack.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Other proposals: an address spelled out, a national phone number, a number of 3-2-4 digits.
SPELLED = r"(?i)(?<![a-z0-9._-])[a-z0-9._-]{2,40}\x20?[\[(]at[\])]\x20?[a-z0-9-]{2,40}\x20?[\[(.](?:dot[\])]\x20?)?[a-z]{2,10}"
NATIONAL = r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
BASE = ("email", "ip", "card", "phone")
MORE = ("spelled", "national", "social")
KINDS = BASE + MORE
CONTEXT_CHARS = 24
CHUNK_CHARS = 4096
CONTEXT_YES = r"(?i)(mail|contact|write|phone|tel|call|mobile|cell|fax|card|visa|ssn|social|address|ip|host|from)[^a-z]*$"
CONTEXT_NO = r"(?i)(version|isbn|order|invoice|serial|part|page|figure|table|section|doi|id)[^a-z]*$"
#: Common endings of mail domains.
ENDINGS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "info")
SPANS = "array<struct<ord:int,kind:string,start:bigint,end:bigint,m:string>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    doubled = F.transform(values, lambda v, i: F.when(i % 2 == 1, v * 2 - F.when(v > 4, 9).otherwise(0)).otherwise(v))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _ip_ok(m: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(m, r"\."), lambda p: (F.char_length(part(p)) <= 3) & (F.coalesce(F.substring(part(p), 1, 3).try_cast("int"), F.lit(999)) <= 255))


def proposals(text: Column) -> Column:
    """All proposed spans of one text as ``SPANS``; those of base kinds have passed their tests."""
    between = lambda n, lo, hi: (n >= lo) & (n <= hi)
    n_digits = lambda s: F.char_length(_digits(s["m"]))
    at = F.contains(text, F.lit("@"))
    email = matches(text, EMAIL, at)
    ip = F.filter(matches(text, IP), lambda s: _ip_ok(s["m"]))
    card = F.filter(matches(text, CARD), lambda s: between(n_digits(s), 16, 19) & luhn(F.substring(_digits(s["m"]), 1, 19)))
    phone = F.filter(matches(text, PHONE, F.contains(text, F.lit("+"))), lambda s: between(n_digits(s), 8, 15))
    more = [matches(text, SPELLED, F.contains(F.lower(text), F.lit("at"))), matches(text, NATIONAL), matches(text, SOCIAL)]
    found = dict(zip(KINDS, (email, ip, card, phone, *more), strict=True))

    def all_of(v):
        base = [of_kind(v[k], k, i) for i, k in enumerate(BASE)]
        return F.concat(*base, *(of_kind(apart(v[k], *(v[b] for b in BASE)), k, len(BASE) + i) for i, k in enumerate(MORE)))

    return bound(found, all_of).cast(SPANS)


def _votes(s: Column, before: Column) -> list[Column]:
    """1, 0 or -1 (no opinion) of the form, gazetteer and context labelers."""
    m, kind = s["m"], s["kind"]
    digits = _digits(m)
    ending = F.lower(F.regexp_extract(m, r"([A-Za-z]+)$", 1))
    varied = F.char_length(F.regexp_replace(digits, r"(.)(?=.*\1)", "")) >= 4
    form = (
        F.when(kind == "email", F.when(m.rlike(r"^[A-Za-z0-9][^@]*@[^@]*\.[A-Za-z]{2,}$"), 1).otherwise(0))
        .when(kind == "spelled", F.when(m.rlike(r"(?i)[\[(]at[\])].*[\[(]dot[\])]"), 1).otherwise(-1))
        .when(kind == "ip", F.when(m.rlike(r"^(0|10|127|255)\."), 0).otherwise(1))
        .when(kind == "social", F.when(m.rlike("^(000|666|9..)|-00-|-0000$"), 0).otherwise(F.when(varied, 1).otherwise(0)))
        .otherwise(F.when(varied, 1).otherwise(0))
    )
    gazetteer = (
        F.when(kind.isin("email", "spelled"), F.when(ending.isin(*ENDINGS), 1).otherwise(0))
        .when(kind.isin("phone", "national"), F.when(digits.rlike("^1?[2-9]..[2-9]"), 1).otherwise(-1))
        .when(kind == "card", F.when(digits.rlike("^(4|5[1-5]|2[2-7]|3[47]|6011|65)"), 1).otherwise(-1))
        .otherwise(-1)
    )
    context = F.when(before.rlike(CONTEXT_NO), 0).when(before.rlike(CONTEXT_YES), 1).otherwise(-1)
    return [form, gazetteer, context]


LABELERS = ("form", "gazetteer", "context")


def fit_votes(counts: dict[tuple, int], rounds: int = 100) -> dict:
    """Expectation-maximisation for labelers that err independently given the truth.

    ``counts``: votes -> number of spans.  Gives the share of true spans and, by labeler,
    the chance of each vote for true and for false ones.  It starts from labelers that are
    right three times in four.
    """
    share, total = 0.5, sum(counts.values())
    start = {1: (0.6, 0.2), 0: (0.2, 0.6), -1: (0.2, 0.2)}
    chance = [dict(start) for _ in LABELERS]
    for _ in range(rounds if total else 0):
        post = {v: posterior(v, share, chance) for v in counts}
        true = sum(n * post[v] for v, n in counts.items())
        share = min(max(true / total, 0.01), 0.99)
        for k in range(len(LABELERS)):
            for vote in (1, 0, -1):
                t = sum(n * post[v] for v, n in counts.items() if v[k] == vote)
                f = sum(n * (1 - post[v]) for v, n in counts.items() if v[k] == vote)
                chance[k][vote] = ((t + 1 * start[vote][0] * 3) / (true + 3), (f + 1 * start[vote][1] * 3) / (total - true + 3))
    return {"share": share, "chance": chance}


def posterior(votes: tuple, share: float, chance: list[dict]) -> float:
    t, f = share, 1 - share
    for k, v in enumerate(votes):
        t, f = t * chance[k][v][0], f * chance[k][v][1]
    return t / (t + f) if t + f else share


def _lookup(table: dict, *keys: Column) -> Column:
    """A map literal of few entries by joined key; null where there is none."""
    flat = [F.lit(x) for k, v in table.items() for x in ("|".join(map(str, k)), float(v))]
    return F.try_element_at(F.create_map(*flat), F.concat_ws("|", *(k.cast("string") for k in keys))) if flat else F.lit(None).cast("double")


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.9) -> DataFrame:
    """One row per document: (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans,
    n_more, probabilities: the classifier's for each span, in the order of ``spans``).

    A null text counts as empty, repeated rows each give a row, other columns are ignored,
    an empty table gives no rows.  No pattern backtracks over a long text, so a text may be
    one match or hold any number of them.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.monotonically_increasing_id().alias("row"), proposals(text).alias("found"))

    def voted(chunks):
        def of(s):
            k, at = F.floor(s["start"] / CHUNK_CHARS).cast("int"), (s["start"] % CHUNK_CHARS).cast("int")
            near = F.concat(F.when(k > 0, F.substring(F.try_element_at(chunks, k), CHUNK_CHARS + 1 - CONTEXT_CHARS, CONTEXT_CHARS)).otherwise(""), F.substring(F.coalesce(F.try_element_at(chunks, k + 1), F.lit("")), F.lit(1), at))
            return bound({"before": F.substring(near, -CONTEXT_CHARS, CONTEXT_CHARS)}, lambda v: F.struct(*(s[c].alias(c) for c in ("ord", "kind", "start", "end")), *(x.alias(n) for x, n in zip(_votes(s, v["before"]), LABELERS, strict=True)), F.least(F.char_length(_digits(s["m"])), F.lit(20)).alias("digits")))

        return of

    # a text is cut into chunks once, as each look into a long one from its start takes its length
    cut = F.when(F.size("found") > 0, F.regexp_extract_all("text", F.lit("(?s).{1,%d}" % CHUNK_CHARS), F.lit(0)))
    judged = bound({"chunks": cut, "found": F.col("found")}, lambda v: F.transform(v["found"], voted(v["chunks"])))
    rows = written(rows.select("doc_id", "row", judged.alias("found")), "personal-proposals")
    held = rows.filter(F.size("found") > 0).select("row", F.explode("found").alias("s")).select("row", "s.*")
    patterns = held.groupBy(*LABELERS).count().collect()  # 27 rows at most
    model = fit_votes({tuple(r[n] for n in LABELERS): r["count"] for r in patterns})
    all_votes = list(itertools.product((1, 0, -1), repeat=len(LABELERS)))
    held = held.withColumn("truth", _lookup({v: posterior(v, model["share"], model["chance"]) for v in all_votes}, *(F.col(n) for n in LABELERS)))
    # the span classifier: naive Bayes of kind, digits and votes, learnt from the posteriors
    features = [("kind", F.col("kind")), ("digits", F.col("digits")), *((n, F.col(n)) for n in LABELERS)]
    seen = held.select("truth", F.explode(F.array(*(F.struct(F.lit(n).alias("f"), c.cast("string").alias("v")) for n, c in features))).alias("x"))
    learnt = seen.groupBy("x.f", "x.v").agg(F.sum("truth").alias("t"), F.sum(1 - F.col("truth")).alias("n")).collect()  # 40 rows at most
    by_feature: dict[str, list] = {}
    for r in learnt:
        by_feature.setdefault(r["f"], []).append(r)
    odds = {}
    for f, got in by_feature.items():
        t, n = sum(r["t"] for r in got) + len(got), sum(r["n"] for r in got) + len(got)
        odds |= {(f, r["v"]): math.log((r["t"] + 1) / t) - math.log((r["n"] + 1) / n) for r in got}
    share = model["share"]
    logit = F.lit(math.log(share / (1 - share)))
    for n, c in features:
        logit = logit + F.coalesce(_lookup(odds, F.lit(n), c), F.lit(0.0))
    scored = held.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(30.0)), F.lit(-30.0)))))
    kept = scored.filter((F.col("ord") < len(BASE)) | (F.col("score") >= threshold))
    spans = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("ord", "start", "end", "kind", "score"))).alias("all"))
    none = F.array().cast("array<struct<ord:int,start:bigint,end:bigint,kind:string,score:double>>")
    out = rows.select("doc_id", "row").join(spans, "row", "left").withColumn("all", F.coalesce("all", none))
    base = F.filter("all", lambda s: s["ord"] < len(BASE))
    count = lambda kind: F.size(F.filter("all", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    n_more = F.size(F.filter("all", lambda s: s["ord"] >= len(BASE))).cast("long").alias("n_more")
    return out.select("doc_id", *(count(k) for k in BASE), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"), n_more, F.transform("all", lambda s: F.round(s["score"], 6)).alias("probabilities"))
