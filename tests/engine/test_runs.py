"""Texts and words of documents without a row for each glyph."""

import zlib

import pytest
from pyspark.sql import functions as F

from quire import document_queries as dq
from quire import queries
from quire.plans import layout
from quire.sources import document as dc
from quire.sources import relations
from quire.sources.syntax import Name, Parser, Ref, Stream, write


def odd(rotate, body, crop=(0, 0, 300, 400), more=None):
    cmap = Stream({}, b"2 beginbfchar <01> <00660069> <02> <0000> endbfchar 1 beginbfrange <41> <43> <0391> endbfrange")
    o = {
        1: {"Type": Name("Catalog"), "Pages": Ref(2)},
        2: {"Type": Name("Pages"), "Kids": [Ref(3)], "Count": 1, "MediaBox": [0, 0, 300, 400]},
        3: {"Type": Name("Page"), "Parent": Ref(2), "CropBox": list(crop), "Rotate": rotate, "Contents": Ref(4), "Resources": {"Font": {"F1": Ref(5), "F2": Ref(6), "F3": Ref(9)}, "XObject": {"X": Ref(8)}}},
        4: Stream({}, body),
        5: {"Type": Name("Font"), "Subtype": Name("TrueType"), "BaseFont": Name("Any"), "FirstChar": 32, "Widths": [250, 400, *range(300, 390)], "ToUnicode": Ref(7)},
        6: {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Courier")},
        7: cmap,
        8: Stream({"Subtype": Name("Form"), "Matrix": [1, 0, 0, 1, 20, 30]}, b"BT /F2 9 Tf 5 5 Td (in a form) Tj ET"),
        9: {"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name("Wide"), "ToUnicode": Ref(7), "DescendantFonts": [{"DW": 500}]},
    }
    return dc.build(o, 1)


BODY = b"""BT /F1 12 Tf 3 Tw 1 Tc 90 Tz 40 300 Td (ab  \\(AB\\)\\101 C) Tj [(x y) -300 <0102 41> 250 (z)] TJ T* (no) ' /F2 10 Tf 0 Tw 0 Tc 100 Tz
1 0 0 1 100 200 Tm (placed here) Tj 1 0 0 1 290 200 Tm <6F7574206F6620746865> Tj 0 1 -1 0 50 50 Tm (up the side) Tj
1 0 .2 1 60 120 Tm (slanted) Tj 1 0 0 1 60 90 Tm true (t) Tj /F3 8 Tf 1 0 0 1 60 80 Tm <00410001> Tj 5 Tj 1 0 0 1 130 207 Tm /F2 10 Tf (near) Tj ET
q 1 0 0 1 10 10 cm BT /F2 11 Tf 70 140 Td (moved) Tj ET Q /X Do BI /W 1 ID \xff(\xff EI BT /F2 11 Tf 70 250 Td (end) Tj ET % rest"""


@pytest.fixture(scope="module")
def files(spark):
    data = [odd(r, BODY, c) for r in (0, 90, 180, 270) for c in ((0, 0, 300, 400), (50, 60, 250, 260))]
    data += [odd(0, b"BT /F2 11 Tf 70 250 Td () Tj ET"), dc.from_pages([[(72, 700, "a b"), (72, 686, " ")], [], [(72, 700, "é ß")]]), b"none", zlib.compress(b"x")]
    return spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)] + [(99, None)], "doc_id long, content binary").cache()


def test_placed_glyphs():
    doc = dc.Document(odd(0, BODY), strict=True)
    glyphs = dc.interpret(doc, doc.pages()[0][1])[0]
    assert "".join(g.unicode for g in glyphs) == "ab  (ΑΒ)Α Γx yfi\x02Αznoplaced hereout of theup the sideslantedΑfinearmovedin a formend"
    a, b, c = glyphs[:3]
    widths = {k: w for k, w in enumerate([250, 400, *range(300, 390)], 32)}
    step = lambda k, extra: (widths[ord(k)] / 1000 * 12 + 1 + extra) * 0.9
    assert (a.x, a.y, a.size) == (40, 300, 12) and b.x == pytest.approx(40 + step("a", 0)) and c.x == pytest.approx(b.x + step("b", 0))
    assert glyphs[3].x == pytest.approx(c.x + step(" ", 3)) and b.advance == pytest.approx(widths[ord("b")] / 1000 * 12 * 0.9)
    assert [k for _, k, _ in doc.problems] == ["content"] * 2  # true and 5 are no strings


def test_texts_are_the_glyphs_in_paint_order(files):
    g = relations.relation(files, "glyphs").groupBy("doc_id", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "unicode"))), lambda s: s["unicode"]), ""))
    got = sorted(map(tuple, relations.relation(files, "texts").collect()))
    assert got == sorted(map(tuple, g.collect())) and len({t for _, _, t in got[:8]}) > 1
    assert [t for i, _, t in got if i == 9] == ["a b ", "é ß"]


def test_words_are_those_of_the_windows(files):
    near = lambda rows: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)
    want, got = layout.words(relations.relation(files, "glyphs")).collect(), relations.relation(files, "words").collect()
    assert near(got) == near(want) and len(got) > 80


@pytest.mark.parametrize("name", ["document_text", "document_words", "document_open", "document_toc", "document_repair"])
def test_only_texts_are_dealt_out(spark, sf_dir, name):
    plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan and "collect_list" not in plan
    assert dq.files(spark, sf_dir).count() == dq.docs(spark, sf_dir).count()


def test_names_with_escapes_are_keys():
    value = {"x y": 1, "A#": Name("b c"), "Plain": {"(": [Name("d"), 2.5]}}
    assert Parser(write(value)).object() == value
    assert Parser(b"<</A#20B 1/C(x\\)y(z))>>").object() == {"A B": 1, "C": b"x)y(z)"}
