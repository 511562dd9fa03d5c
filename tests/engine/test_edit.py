import pytest

from quire.sources import document as dc
from quire.sources import inventory as inv
from quire.sources.edit import Editor
from quire.sources.syntax import Ref


def make(*texts):
    return dc.from_pages([[(72, 700, t)] for t in texts])


def texts(data):
    d = dc.Document(data, strict=True)
    return ["".join(g.unicode for g in dc.interpret(d, p)[0]) for _, p in d.pages()]


@pytest.mark.parametrize("garbage", range(5))
def test_saving_keeps_the_pages(garbage):
    e = Editor(make("a", "b", "c"))
    e.add({"Unused": True})
    data = e.save(garbage)
    assert texts(data) == ["a", "b", "c"]
    nums = sorted(n for n in dc.Document(data).entries if dc.Document(data).get(Ref(n)) is not None)
    if garbage >= 2:
        assert nums == list(range(1, len(nums) + 1))
    assert (b"Unused" in data) == (garbage == 0)


def test_page_operations():
    e = Editor(make("a", "b", "c"))
    e.select([2, 0, 0])
    e.rotate(1, 90)
    e.new_page(1)
    data = e.save(3)
    assert texts(data) == ["c", "", "a", "a"]
    d = dc.Document(data)
    assert d.boxes(d.pages()[2][1])[2] == 90
    e = Editor(data)
    e.delete_pages([1])
    e.append_pages(Editor(make("x", "y")))
    assert texts(e.save(4)) == ["c", "a", "a", "x", "y"]


def test_catalog_edits_and_incremental_save():
    e = Editor(make("a", "b"))
    e.set_metadata(Title="Né", Author="me")
    e.set_toc([(1, "one", 0), (2, "two", 1), (1, "three", 1)])
    e.set_labels([(0, "", "r", 1), (1, "P-", "D", 7)])
    e.embed("n.txt", b"data", "note")
    e.annotate(0, "Link", [1, 2, 3, 4], uri="http://x.y")
    e.insert_text(1, 72, 600, "more")
    data = e.save_incremental()
    assert data.startswith(make("a", "b")) and texts(data) == ["a", "bmore"]
    d = dc.Document(data, strict=True)
    assert d.metadata()["Title"] == "Né" and d.outline() == [(1, "one", 0), (2, "two", 1), (1, "three", 1)]
    assert [r[1:] for r in inv.label_rules(0, d)] == [(0, "", "r", 1), (1, "P-", "D", 7)]
    assert list(inv.attachments(0, d))[0][-1] == b"data" and d.links(d.pages()[0][1])[0][1] == "http://x.y"
    with pytest.raises(ValueError):
        e.set_toc([(2, "too deep", 0)])


def test_redacted_text_is_gone():
    e = Editor(dc.from_pages([[(72, 700, "keep"), (72, 600, "hide")]]))
    assert e.redact(0, [60, 590, 200, 615]) == 4
    assert not e.can_save_incrementally()
    data = e.save(1, compress=False)
    assert texts(data) == ["keep"] and b"hide" not in data


def test_keys():
    e = Editor(make("a"))
    num = e.pages()[0].num
    e.set_key(num, "Rotate", "180")
    assert e.get_key(num, "Rotate") == "180"
    e.set_key(num, "Rotate", "null")
    assert e.get_key(num, "Rotate") is None
