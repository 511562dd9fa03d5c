import zlib

import numpy as np

from quire.llm import quality as q
from tests.llm.cases import odd_documents


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(y) - n1))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = q.classify(docs, labels)
    assert out.count() == docs.count()
    got = out.join(labels, "doc_id").filter("held_out").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id)
    y = got.quality.to_numpy()
    assert auc(got.score.to_numpy(), y) > 0.95
    assert (got.predicted == y).mean() > 0.95


def test_labels_of_the_held_out_fold_have_no_say(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.withColumn("quality", q.F.when(q.fold() == 0, 1 - labels.quality).otherwise(labels.quality))
    a, b = (q.classify(docs, x).orderBy("doc_id").collect() for x in (labels, turned))
    assert a == b


def test_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (7, 1, None), (None, 1, 1), (9, None, 0)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0), labels.filter("quality = 1")):
        out = q.classify(docs, known).collect()
        assert len(out) == docs.count()
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert q.classify(docs.limit(0), labels).count() == 0


def test_calibration_measures_whole_texts(spark, monkeypatch):
    import random

    random.seed(4)
    noise = lambda n: "".join(random.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n))
    third = "plain words of a plain text " * 300
    rows = [(k, (third + noise(40000) + third + noise(40000) + third) if k % 2 else third * 12) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(40)], "doc_id long, quality int")
    model = q.fit(docs, labels)
    known = [(k, t) for k, t in rows if zlib.crc32(str(k).encode()) % 5]
    pair = q.Compressors(model["good"], model["bad"])
    whole = {k: pair.measures(t.encode()) for k, t in known}
    order = [r.doc_id for r in spark.createDataFrame([(k,) for k, _ in known], "doc_id long").orderBy(q.F.xxhash64("doc_id"), "doc_id").collect()]
    assert np.allclose(model["center"], np.median([whole[k] for k in order[1::2]], 0))
    assert len(q._drawn(noise(10**6).encode())) == q.SAMPLE_BLOCKS * q.BLOCK_BYTES
