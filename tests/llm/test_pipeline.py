import hashlib
import re

import corpus_pipeline as cp
from quire.llm import mixing
from quire.llm import set_join as sj
from tests.llm.cases import kept_clashes, odd_documents
from tests.llm import test_line_dedup as lines
from tests.llm import test_ngram_join as near
from tests.llm.test_bpe_codec import REF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_on_a_small_corpus(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in cp.STAGES:
        before, docs = docs, cp.written(stage(spark, docs, sf_dir), name)
        kept[name] = docs.collect()
        if name == "quality":
            assert set(kept[name]) <= set(before.collect())
            assert 0.6 * before.count() < docs.count() < before.count()
        elif name == "lines":
            rows = [(r.doc_id, r.h, r.text) for r in before.select("doc_id", lines.ld.F.xxhash64("text").alias("h"), "text").collect()]
            want = {d: h for d, n, k, h in lines.brute(rows)}
            assert all(want[r.doc_id] == hashlib.sha256(r.text.encode()).hexdigest() and r.n_chars == len(r.text) for r in docs.collect())
            gone = {r[0] for r in rows} - {r.doc_id for r in docs.collect()}
            assert all(want[d] in {hashlib.sha256(b"\n" * k).hexdigest() for k in range(50)} for d in gone)
        elif name == "near":
            want = {d for d, _, c in near.brute([(r.doc_id, r.text) for r in before.collect()]) if d == c}
            assert {r.doc_id for r in docs.collect()} == want and docs.count() == len(want)
        elif name == "mix":
            source = {r.doc_id: r for r in before.collect()}
            for r in docs.collect():
                have = set(WORD.findall(source[r.doc_id].text))
                assert set(WORD.findall(r.text)) <= have and r.n_chars == len(r.text)
        if name != "encode":
            assert docs.columns == columns
    want = sorted((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()) for r in kept["mix"] for ids in [REF.encode_ordinary(r.text)])
    assert sorted(map(tuple, kept["encode"])) == want
    assert sorted(map(tuple, cp.run(spark, sf_dir).collect())) == want


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


def test_stages_carry_odd_rows_and_clashing_columns(spark, sf_dir):
    near_copy = " ".join(f"n{k}" for k in range(90))
    docs = odd_documents(spark, [(None, near_copy, "en", "c"), (31, near_copy + " more", "en", "c"), (32, near_copy, "en", None)])
    for name, stage in cp.STAGES:
        out = cp.written(stage(spark, docs, sf_dir), f"odd-{name}")
        if name == "encode":
            assert out.count() == docs.count()
            continue
        rows = out.collect()
        assert out.columns == docs.columns and kept_clashes(rows) and 0 < len(rows)
        assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.collect()}
        if name == "near":
            assert sum("n5 " in (r.text or "") for r in rows) == 1


def test_empty_texts_have_a_score(spark, sf_dir):
    docs = odd_documents(spark).filter("text is null or text = ''")
    assert cp.stage_quality(spark, docs, sf_dir).count() <= docs.count()
    assert cp.stage_near(spark, docs, sf_dir).count() == 3  # without words they are like no other


def test_a_task_has_one_worker(spark, sf_dir):
    """Two Python operators in one task take two workers, and those of RDDs of Python objects are others again."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    docs = odd_documents(spark)
    assert plan(cp.stage_lines(spark, docs, sf_dir)).count("ArrowEvalPython") == 1
    sets = near.nj._token_rows(5)
    sets = cp.written(docs.select("doc_id", "text").mapInArrow(sets, sj.TOKENS).dropDuplicates(["name"]), "sets")
    pairs = sets.select(lines.ld.F.col("name").alias("a")).crossJoin(sets.select(lines.ld.F.col("name").alias("b"))).filter("a < b")
    links = near.nj._links(pairs, sets)
    assert links.count() > 0 and "Python" not in plan(links)
    sources = mixing.source_table(spark, [(0, "a", 5, 2.5, 1), (1, None, 7, 9.5, 1)])
    assert [tuple(r) for r in sources.collect()] == [(0, "a", 5, 2.5, 1), (1, None, 7, 9.5, 1)]
    assert mixing.source_table(spark, []).count() == 0
    assert "PythonRDD" not in sources._jdf.queryExecution().toRdd().toDebugString()
