"""Scores on odd texts and at ties, against their SQL; tokens aren't shuffled."""

import duckdb
import pytest

from quire import queries
from quire.operators import scoring

TEXTS = ["", "one two", None, "\n \t", "a a b", "A B b\x0bc", "x y İ ΟΔΟΣ", "i οδοσ x y", "ẞ ß ss", " ".join(["w"] * 3 + ["v"] * 5117)]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Each text against each: pairs are documents 20 ids apart."""
    at = f"{tmp_path_factory.mktemp('odd')}"
    tied = [" ".join(["w"] * k + [f"u{j}" for j in range(5120 - k)]) for k in range(1, 40, 2)]
    rows = [(20 * (2 * p + s), t) for p, (a, b) in enumerate((a, b) for a in TEXTS for b in TEXTS) for s, t in ((0, a), (1, b))]
    rows += [(100_000 + 1000 * k + 20 * s, t) for k, x in enumerate(tied) for s, t in ((0, x), (1, "w " * 40))]
    df = spark.createDataFrame([(i, t, f"s{i % 3}") for i, t in rows], "doc_id long, text string, source string")
    df.repartition(4).write.parquet(f"{at}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet/*.parquet'")
    return at, con


@pytest.mark.parametrize("name", ["score_content", "score_head_to_head", "score_aggregate", "score_worst", "score_causes"])
def test_odd_texts(spark, odd, name):
    got, want = queries.QUERIES[name](spark, odd[0]), odd[1].sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    # floats as they are: a rounded value has one nearest float
    assert sorted(map(repr, map(tuple, got.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_operator_scores_empty_texts(spark):
    df = spark.createDataFrame([(1, "", None), (2, "a", ""), (3, None, "b"), (4, "a b b", "b c")], "id long, hyp string, ref string")
    got = {r.id: tuple(r)[1:] for r in scoring.content_scores(df).collect()}
    assert got == {1: (0, 0, 1.0, 1.0, 1.0, 1.0), 2: (1, 0, 0.0, 0.0, 0.0, 0.0), 3: (0, 1, 0.0, 0.0, 0.0, 0.0), 4: (3, 2, 1 / 3, 0.5, 0.4, 1 / 3)}


@pytest.mark.parametrize("name,most", [("score_content", 2), ("score_causes", 4), ("score_worst", 2)])
def test_tokens_are_not_shuffled(spark, sf_dir, name, most):
    plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= most and "Generate" not in plan
