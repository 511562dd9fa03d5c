import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quire.llm import fingerprints as fp
from quire.llm import shared
from tests.llm.cases import odd_documents


def test_edited_texts_match_brute_force(spark):
    docs = odd_documents(spark)
    rows = docs.selectExpr("doc_id", "coalesce(text, '') t").selectExpr("doc_id", "t", "xxhash64(t) h").collect()
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    want = []
    for k, (i, t, _) in enumerate(rows):
        nxt, n = rows[(k + 1) % len(rows)][1], len(t)
        want.append((i, n, hashlib.sha256((t[: n - n // 4] + nxt[: n // 4]).encode()).hexdigest()))
    got = fp.neighbours(docs).collect()
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in got], key=repr) == sorted(want, key=repr)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    same = {r.doc_id: r.fingerprint for r in got}
    assert same[1] == same[2] != same[3]
    assert next(r for r in got if r.doc_id == 1).near_next == 1.0
    assert fp.neighbours(docs.limit(0)).count() == 0
    alone = fp.neighbours(docs.filter("doc_id = 6")).first()
    assert alone.near_next == 1.0


def test_sums_are_homomorphic(spark):
    a, b = "first. one\nsecond! two", "third\nfirst. one"
    df = spark.createDataFrame([(a, b, a + "\n" + b, b + "\n" + a)], "a string, b string, ab string, ba string")
    for c in df.columns:
        df = fp.with_fingerprint(df, c, f"f_{c}")
    f = {c[2:]: F.col(c) for c in df.columns if c[:2] == "f_"}
    text = lambda x: fp.as_text(x)
    r = df.select(text(f["ab"]).alias("ab"), text(f["ba"]).alias("ba"), text(fp.add(f["a"], f["b"])).alias("sum"), text(fp.subtract(f["ab"], f["b"])).alias("rest"), text(f["a"]).alias("a")).first()
    assert r.ab == r.ba == r.sum
    assert r.rest == r.a


def test_likeness_follows_shared_sentences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("n_chars > 4000")
    r = fp.neighbours(docs).agg(F.avg("near_edited").alias("e"), F.avg("near_next").alias("n")).first()
    assert 0.6 < r.e < 0.9
    assert r.n < 0.25


def test_kept_three_quarters_show_in_any_shape_of_text(spark):
    random.seed(5)
    run = lambda n, sep=" ": sep.join("".join(random.choices("abcdefghiklmnoprstuvwz", k=random.randint(2, 9))) for _ in range(n))
    rows, line = [], "the same line again and again, over and over"
    for _ in range(40):
        kept = [run(9) for _ in range(60)]
        rows.append(("one line", run(400), None))
        rows.append(("repeats go", "\n".join(kept + [line] * 20), "\n".join(kept + [run(9) for _ in range(20)])))
        rows.append(("repeats come", "\n".join(kept + [run(9) for _ in range(20)]), "\n".join(kept + [line] * 20)))
        rows.append(("short lines come", run(400), None))
        rows.append(("nothing kept", "\n".join([line] * 20 + [run(9)]), run(200)))
    for k, (shape, a, b) in enumerate(rows):
        if b is None:
            cut = len(a) - len(a) // 4
            rows[k] = (shape, a, a[:cut] + (run(len(a) // 28, "\n") if shape[0] == "s" else run(len(a))[: len(a) // 4]))
    df = spark.createDataFrame(rows, "shape string, a string, b string").repartition(4)
    df = fp.with_fingerprint(fp.with_fingerprint(df, "a", "f"), "b", "g").select("shape", fp.likeness(F.col("f"), F.col("g")).alias("x"))
    got = {r["shape"]: r for r in df.groupBy("shape").agg(F.min("x").alias("low"), F.avg("x").alias("mean"), F.max("x").alias("high")).collect()}
    for shape in ("one line", "repeats go", "repeats come"):
        assert got[shape]["low"] > 0.5 and 0.68 < got[shape]["mean"] < 0.82, got[shape]
    assert got["short lines come"]["low"] > 0.4
    assert got["nothing kept"]["mean"] < 0.2 and got["nothing kept"]["high"] < 0.5


def test_low_quantiles_of_edited_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    low, mid = fp.neighbours(docs).filter("n_chars > 200").selectExpr("percentile(near_edited, array(0.01, 0.5)) q").first().q
    assert low > 0.45 and 0.65 < mid < 0.85


@pytest.mark.parametrize("shape", ["one far id", "all null", "one id", "equal rows"])
def test_ranges_of_any_ids_are_even(spark, monkeypatch, shape):
    monkeypatch.setattr(shared, "BUCKET_ROWS", 100)
    ids = {"one far id": "if(id = 7, 1L << 60, id)", "all null": "cast(null as long)", "one id": "5L", "equal rows": "5L"}[shape]
    docs = spark.range(0, 4000, 1, 4).selectExpr(f"{ids} as doc_id", "'same' as text" if shape == "equal rows" else "cast(id as string) as text")
    key = shared.order_key("doc_id", F.xxhash64("text"))
    bounds = shared.order_buckets(docs, key)
    sizes = [r["count"] for r in docs.select(key.alias("k")).groupBy(shared.bucket_of(F.col("k"), bounds).alias("b")).count().collect()]
    assert sum(sizes) == 4000 and len(sizes) >= 35 and max(sizes) < 400
    got = fp.neighbours(docs)
    assert got.count() == 4000 and got.filter("near_next is null").count() == 0
    rows = docs.selectExpr("doc_id", "text", "xxhash64(text) h").collect()
    rows = [r.text for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))]
    want = [hashlib.sha256((a[: len(a) - len(a) // 4] + b[: len(a) // 4]).encode()).hexdigest() for a, b in zip(rows, rows[1:] + rows[:1])]
    assert sorted(r[0] for r in got.select("edited_sha256").collect()) == sorted(want)
