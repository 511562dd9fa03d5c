import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import token_store as ts
from tests.llm.cases import odd_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(rows):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


def test_digests_and_documents_match_brute_force(spark, tmp_path):
    docs = odd_documents(spark)
    path = str(tmp_path / "store")
    ts.write_store(docs, PATH, path)
    rows = sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    got = ts.read_digests(spark, path).orderBy("start").collect()
    want = brute(rows)
    if [r.ids_crc32 for r in got] != [w[3] for w in want]:  # the two texts of id 9, in either order
        want = brute(rows[:-2] + rows[:-3:-1])
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == [w[:4] for w in want]
    back = ts.read_documents(spark, path).orderBy("start").collect()
    assert [list(r.ids) for r in back] == [w[4] for w in want]
    keys = spark.read.parquet(f"{path}/objects").filter("kind = 'c'").groupBy("key").count()
    assert keys.filter("count > 1").count() == 0
    ordered = [r.doc_id for r in spark.read.parquet(f"{path}/recipes").orderBy("start").collect()]
    assert ordered == [w[0] for w in want]


def test_a_changed_chunk_is_noticed(spark, tmp_path):
    path = str(tmp_path / "store")
    ts.write_store(odd_documents(spark), PATH, path)
    objects = spark.read.parquet(f"{path}/objects")
    bad = objects.withColumn("body", F.when(F.col("kind") == "c", F.overlay("body", F.lit(b"\x07\x07"), F.lit(1))).otherwise(F.col("body")))
    bad.write.parquet(str(tmp_path / "bad/objects"))
    for name in ("recipes", "manifest"):
        spark.read.parquet(f"{path}/{name}").write.parquet(str(tmp_path / f"bad/{name}"))
    with pytest.raises(Exception, match="match its key"):
        ts.read_digests(spark, str(tmp_path / "bad")).collect()


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "store")
    ts.write_store(odd_documents(spark).limit(0), PATH, path)
    assert ts.read_digests(spark, path).count() == 0


def test_merkle_root_depends_on_order():
    assert ts.merkle_root([b"a", b"b", b"c"]) != ts.merkle_root([b"b", b"a", b"c"])


def test_odd_words_get_the_librarys_ids():
    random.seed(1)
    marks = list(" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0\u1680\u2003\u2028\u3000\u200b\ufeffabcABCéÉßǅİıﬁŒ\u0308\u0344's't日🙂٣४09-%#<|>") + ["<|endoftext|>", "'re", "'LL", " "]
    texts = ["".join(random.choice(marks) for _ in range(random.randint(0, 30))) for _ in range(3000)] + [None]
    whole = Tokenizer.from_file(PATH)
    whole.encode_special_tokens = True
    tok = ts.WordTokenizer(PATH)
    assert tok.by_word
    want = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(r, "<u4").tolist() for r in tok.encode_all(pa.array(texts, pa.string()))] == want
    tok.by_word = False
    assert [np.frombuffer(r, "<u4").tolist() for r in tok.encode_all(pa.array(texts[-50:], pa.string()))] == want[-50:]


def test_rolling_hash_covers_a_window():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 49408, 5000).astype("<u4"), rng.integers(0, 49408, 700).astype("<u4")
    ends = lambda ids: {tuple(ids[max(0, e - ts.WINDOW) : e].tolist()) for e in ts.cuts(ids)[:-1]}
    assert len(ends(np.concatenate([b, a])) & ends(a)) >= 3  # cuts are found again behind another beginning


def test_a_remembered_word_is_not_taken_apart_again(monkeypatch):
    tok, taken = ts.WordTokenizer(PATH), []

    class Pieces:
        def findall(self, word, pattern=tok.PIECES):
            taken.append(word)
            return pattern.findall(word)

    monkeypatch.setattr(ts, "CACHE_WORDS", 1)
    tok.PIECES = Pieces()
    texts = ["Ab-c1, plain", "Ab-c1, 'LL", "Ab-c1, é9! x"]
    got = [tok.encode(t) for t in texts]
    assert got == [tok.encode_whole(t) for t in texts]
    assert taken.count("ab-c1,") == 1


def test_recipes_are_checked_in_the_worker_that_makes_their_parts(spark, tmp_path):
    path = str(tmp_path / "store")
    ts.write_store(odd_documents(spark), PATH, path)
    plan = ts.read_digests(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2  # the parts, and after a shuffle the sums
    recipes = spark.read.parquet(f"{path}/recipes")
    recipes.withColumn("root", F.unhex(F.sha2("root", 256))).write.parquet(str(tmp_path / "bad/recipes"))
    spark.read.parquet(f"{path}/objects").write.parquet(str(tmp_path / "bad/objects"))
    with pytest.raises(Exception, match="match its root"):
        ts.read_digests(spark, str(tmp_path / "bad")).collect()
