"""Regular-expression spans with code-point offsets, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


SPANS = "array<struct<start:bigint,end:bigint,m:string>>"
#: Matches whose offsets are summed one by one; of more, blocks of so many are summed first.
BLOCK = 256


def bound(values: dict[str, Column], use) -> Column:
    """``use`` of a struct of the values, each evaluated once however often it is used."""
    return F.element_at(F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), use), 1)


def matches(text: Column, pattern: str, gate: Column | None = None) -> Column:
    """array<struct(start long, end long, m string)> of the leftmost non-overlapping
    matches; ``gate`` is a cheap condition without which there are none.

    Offsets add up the lengths of the pieces between matches and of the matches, as
    splitting and extracting walk through a text alike.  They are summed by blocks, so the
    work grows little faster than the matches.
    """
    empty = F.array().cast(SPANS)
    size = lambda p: F.char_length(p["b"]) + F.char_length(p["m"])

    def step(acc, pair):
        start = acc["at"] + F.char_length(pair["b"])
        end = start + F.char_length(pair["m"])
        return F.struct(end.cast("long").alias("at"), F.concat(acc["out"], F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), pair["m"].alias("m")))).alias("out"))

    def from_(pairs, start):
        return F.aggregate(pairs, F.struct(start.cast("long").alias("at"), empty.alias("out")), step, lambda acc: acc["out"])

    def blocks(v):
        number = F.sequence(F.lit(0), F.floor((F.size(v["pairs"]) - 1) / BLOCK).cast("int"))
        return F.transform(number, lambda k: F.slice(v["pairs"], k * BLOCK + 1, BLOCK))

    def offsets(v):
        sums = F.transform(v["blocks"], lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, p: a + size(p)))
        add = lambda a, s: F.struct((a["at"] + s).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(sums, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out")), add, lambda a: a["out"])

    def many(v):
        return bound({"blocks": blocks(v)}, lambda w: bound({"blocks": w["blocks"], "starts": offsets(w)}, lambda x: F.flatten(F.zip_with(x["blocks"], x["starts"], from_))))

    def spans(v):
        return F.when(F.size(v["pairs"]) <= BLOCK, from_(v["pairs"], F.lit(0))).otherwise(many(v))

    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    cut = bound({"found": found, "between": between}, lambda v: F.zip_with(v["found"], F.slice(v["between"], 1, F.size(v["found"])), lambda m, b: F.struct(m.alias("m"), b.alias("b"))))
    present = F.regexp_like(text, F.lit(pattern)) if gate is None else gate & F.regexp_like(text, F.lit(pattern))
    return F.when(present, bound({"pairs": cut}, spans)).otherwise(empty)


def apart(spans: Column, *taken: Column) -> Column:
    """Those of ``spans`` that overlap none of the ``taken`` ones; each of these arrays
    holds spans in order that don't overlap one another, and is looked up by bisection.
    All should be bound or plain columns."""
    steps = F.array(*(F.lit(1 << k) for k in range(28, -1, -1)))

    def free_of(others):
        return lambda s: free(s, others)

    def free(s, others):
        before = F.aggregate(steps, F.lit(0), lambda at, n: F.when((at + n <= F.size(others)) & (F.try_element_at(others, at + n)["start"] < s["end"]), at + n).otherwise(at))
        return F.when(F.size(others) == 0, True).otherwise(F.coalesce(F.try_element_at(others, F.when(before > 0, before))["end"] <= s["start"], F.lit(True)))

    for others in taken:
        spans = F.filter(spans, free_of(others))
    return spans


def listed(spans: Column) -> Column:
    """"kind:start:end" of each span (its ``kind`` field first), comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: Column, kind: str, order: int) -> Column:
    """The spans with their kind's name and place in the list of kinds."""
    return F.transform(spans, lambda s: F.struct(F.lit(order).alias("ord"), F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["m"].alias("m")))
