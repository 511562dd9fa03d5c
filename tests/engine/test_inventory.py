from quire.sources import document as dc
from quire.sources import inventory as inv
from quire.sources.syntax import Name, Ref, Stream


def sample():
    page = {"Type": Name("Page"), "Parent": Ref(2), "Annots": [Ref(7)], "Resources": {"Font": {"F1": Ref(4)}, "XObject": {"I": Ref(5), "X": Ref(6)}}}
    o = {
        1: {"Type": Name("Catalog"), "Pages": Ref(2), "AcroForm": {"Fields": [Ref(8)]}, "Names": {"EmbeddedFiles": {"Names": [b"a.txt", {"F": b"a.txt", "EF": {"F": Ref(10)}}]}, "Dests": {"Kids": [{"Names": [b"top", [Ref(3), Name("XYZ"), 1, 2, None]]}]}},
            "OCProperties": {"OCGs": [Ref(11), Ref(12)], "D": {"OFF": [Ref(12)]}}, "PageLabels": {"Nums": [0, {"S": Name("r")}, 3, {"S": Name("D"), "P": b"A-", "St": 5}]}},
        2: {"Type": Name("Pages"), "Kids": [Ref(3)], "Count": 1},
        3: page,
        4: {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")},
        5: Stream({"Subtype": Name("Image"), "Width": 2, "Height": 1, "BitsPerComponent": 8, "ColorSpace": Name("DeviceGray")}, b"ab"),
        6: Stream({"Subtype": Name("Form"), "BBox": [0, 0, 5, 6], "Resources": {"Font": {"G": Ref(4)}}}, b""),
        7: {"Subtype": Name("Text"), "Contents": b"note", "Rect": [1, 2, 3, 4]},
        8: {"T": b"a", "FT": Name("Tx"), "Kids": [Ref(9)]},
        9: {"T": b"b", "V": b"v"},
        10: Stream({}, b"hello"),
        11: {"Name": b"on"},
        12: {"Name": b"off"},
    }
    return dc.Document(dc.build(o, 1), strict=True)


def test_inventories():
    d = sample()
    assert [r[5] for r in inv.fonts(0, d)] == ["F1", "G"]
    assert list(inv.images(0, d)) == [(0, 0, 5, "I", 2, 1, 8, "DeviceGray", "", 0)]
    assert [r[4:] for r in inv.xobjects(0, d)] == [("Image", None, None, None, None), ("Form", 0, 0, 5, 6)]
    assert list(inv.annots(0, d)) == [(0, 0, 7, "Text", None, "note", 1, 2, 3, 4)]
    assert list(inv.fields(0, d)) == [(0, 9, "a.b", "Tx", "v", 0)]
    assert list(inv.attachments(0, d))[0][-1] == b"hello"
    assert [(r[2], r[3]) for r in inv.layers(0, d)] == [("on", True), ("off", False)]
    assert list(inv.destinations(0, d)) == [(0, "top", 0, 1.0, 2.0)]
    assert list(inv.label_rules(0, d)) == [(0, 0, "", "r", 1), (0, 3, "A-", "D", 5)]


def test_relations_match_their_schemas(spark):
    from quire.sources import relations

    o = dc.from_pages([[(72, 700, "x")]])
    files = spark.createDataFrame([(1, bytearray(o)), (2, bytearray(b"no document")), (3, None)], "doc_id long, content binary")
    for name in relations.SCHEMAS:
        rows = relations.relation(files, name).collect()
        assert {r.doc_id for r in rows} <= {1, 2}
    assert relations.relation(files, "documents").filter("doc_id = 1").first().page_count == 1
    assert relations.relation(files, "diagnostics").filter("doc_id = 2").count() > 0
