import pytest
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.functions import text as tx
from quire.operators import markup, pageset
from quire.plans import layout


def test_page_ranges():
    assert pageset.page_range("1-3,5,-1", 6) == [0, 1, 2, 4, 5]
    assert pageset.page_range("3-1", 3) == [2, 1, 0]
    for bad in ("x", "9", "0"):
        with pytest.raises(ValueError):
            pageset.page_range(bad, 3)


def test_scalars(spark):
    one = spark.range(1)
    get = lambda *c: one.select(*c).first()
    n = F.lit(1994)
    assert get(tx.roman(n), tx.roman(F.lit(4), False), tx.alpha(F.lit(28), False), tx.alpha(F.lit(26))) == ("MCMXCIV", "iv", "bb", "Z")
    assert get(tx.json_number(F.lit(2.5)), tx.json_number(F.lit(3.0)), tx.json_number(F.lit(float("nan")))) == ("2.5", "3", "0")
    assert get(tx.pdf_string(F.lit("a(b)")), tx.pdf_string(F.lit("é"))) == ("(a\\(b\\))", "<FEFF00E9>")
    assert get(tx.strip_subset_tag(F.lit("ABCDEF+Sans")), tx.style_flags(F.lit("Times-BoldItalic")), tx.language(F.lit("EN_us"))) == ("Sans", 22, "en-US")
    assert get(*g.paper_size(F.lit("A4-l"))) == (842, 595)
    empty, full = g.Rect.of(5, 5, 5, 9), g.Rect.of(1, 1, 2, 2)
    assert tuple(get(*empty.union(full).columns())) == (1, 1, 2, 2)
    assert tuple(get(*g.Rect.of(0, 0, 1, 1).intersect(g.Rect.of(2, 2, 3, 3)).columns())) == (0, 0, 0, 0)
    assert get(g.Matrix.of(1, 2, 2, 4, 0, 0).invert().a)[0] is None
    assert get(tx.cmyk_rgb(F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(0.0)))[0] == 0xFF00FF


def test_upper_median(spark):
    assert spark.range(1).select(layout.upper_median(F.array(*map(F.lit, (4, 1, 3, 2))))).first()[0] == 3


def test_html():
    text, links = markup.text_and_links("<h1>A&amp;b</h1><script>x</script><p>c <a href='u'>d</a></p><p></p><p></p><p>e</p>")
    assert text.split("\n")[0] == "A&b" and "x" not in text and links == ["u"] and "\n\n\n" not in text
    cells = markup.table_cells("<table><tr><td rowspan=2>a</td><td>b</td></tr><tr><td colspan='2'>c</td></tr></table>")
    assert cells == [(0, 0, 0, 2, 1, "a"), (0, 0, 1, 1, 1, "b"), (0, 1, 1, 1, 2, "c")]


def test_char_accuracy_tells_letters_beyond_ascii_apart(spark, tmp_path):
    from quire import queries

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    texts = ["été à l'île", "êtë â l'ïle", "日本語の本文", "中国的文章", "🙂 plain", "plain"]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.id: r.accuracy for r in queries.score_char_accuracy_whole(spark, str(tmp_path)).collect()}
    assert got == {k: round(max(0, 1 - distance(a, b) / len(b)), 9) for k, (a, b) in enumerate(zip(texts, texts[1:], strict=False))}


def test_sequence_scores_see_the_end_of_long_texts(spark):
    from quire.operators import scoring

    words = [f"w{k}" for k in range(60_000)]
    df = spark.createDataFrame([(" ".join(words), " ".join(words[:54_000] + ["other"] * 6_000))], "h string, r string")
    whole, capped = df.select(scoring.sequence_scores(F.col("h"), F.col("r")), scoring.sequence_scores(F.col("h"), F.col("r"), scoring.TOKEN_CAP)).first()
    assert whole.lev == pytest.approx(0.9) and whole.order_score == 1
    assert capped.lev == 1
