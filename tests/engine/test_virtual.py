"""Layout of virtual pages in arrays: against a layout by hand, and without a shuffle."""

import pytest

from quire import queries
from quire.operators import views
from quire.plans import virtual

TEXTS = [
    "", "\n", " ", " \n  \n", "one", "one two  three \n\n four", "\ttab\r\n\x0bvt  nbsp", "é" * 71 + " ß\n" + "日本 語" * 40, "🙂 a\n" * 50, None,
    "x" * 70, "x" * 140 + "\n", "x" * 141, "\n".join(f"line {k}" if k % 3 else " " for k in range(200)), "a  b\n" * 47 + "\n\n\nend",
]


def by_hand(text):
    """(page_no, row, src_line, text) of every line, and of those with ink block_no, line_no too."""
    n, every, inked, last = 0, [], [], None
    for i, line in enumerate(text.split("\n")):
        for k in range(max(1, -(-len(line) // 70))):
            piece, page, row = line[k * 70 : k * 70 + 70], n // 46, n % 46
            every.append((page, row, i, piece))
            if piece.strip(" "):
                if last is None or last[0] != page:
                    block, first = 0, row
                elif row - last[1] > 1:
                    block, first = block + 1, row
                inked.append((page, row, i, piece, block, row - first))
                last = page, row
            n += 1
    return every, inked


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(2).cache()


def told(rows):
    return sorted(map(tuple, rows))


@pytest.mark.parametrize("part", [1, virtual.PART_BYTES])
def test_lines_words_and_characters(docs, part, monkeypatch):
    monkeypatch.setattr(virtual.laid_out, "__defaults__", (part, ("doc_id",)))
    made = [(i, *by_hand(t)) for i, t in enumerate(TEXTS) if t is not None]
    assert told(virtual.lines(docs).select("doc_id", "page_no", "row", "src_line", "text").collect()) == told((i, *r) for i, e, _ in made for r in e)
    assert told(virtual.numbered_lines(docs).select("doc_id", "page_no", "row", "src_line", "text", "block_no", "line_no").collect()) == told((i, *r) for i, _, k in made for r in k)
    words = []
    for i, _, inked in made:
        for page, row, _, text, block, line in inked:
            at, no = 0, 0
            for w in text.split(" "):
                if w:
                    words.append((i, page, 72 + at * 6.6, 72.0 + row * 14, 72 + (at + len(w)) * 6.6, 83.0 + row * 14, w, block, line, no))
                    no += 1
                at += len(w) + 1
    assert told(virtual.words(docs).collect()) == told(words)
    order = sorted(words, key=lambda w: (w[0], w[1], w[3], w[2], w[7], w[8], w[9]))
    place, expected = {}, []
    for w in order:
        place[w[:2]] = place.get(w[:2], 0) + 1
        expected.append((w[0], w[1], w[6], place[w[:2]]))
    assert told(views.sorted_words(docs).collect()) == told(expected)
    chars = [(i, p, b, n, k, c, 72 + k * 6.6, 72.0 + r * 14, 72 + k * 6.6 + 6.6, 83.0 + r * 14) for i, _, inked in made for p, r, _, t, b, n in inked for k, c in enumerate(t)]
    assert told(virtual.chars(docs).collect()) == told(chars)
    nested = [(r.doc_id, r.page_no, b.block_no, x.line_no, *c) for r in views.rawdict(docs).collect() for b in r.blocks for x in b.lines for c in x.chars]
    assert told(nested) == told(chars)
    pages, blocks = {}, {}
    for i, _, inked in made:
        for p, r, _, t, b, n in inked:
            pages.setdefault((i, p), []).append(t)
            blocks.setdefault((i, p, b), []).append((r, t))
    assert told(views.text(docs).collect()) == told((*k, "".join(t + "\n" for t in v)) for k, v in pages.items())
    assert told(virtual.blocks(docs).collect()) == told((i, p, 72.0, 72.0 + v[0][0] * 14, max(72 + len(t) * 6.6 for _, t in v), 83.0 + v[-1][0] * 14, "\n".join(t for _, t in v), b, 0) for (i, p, b), v in blocks.items())
    counts = [(r.doc_id, r.page_no, r.n_blocks, r.n_lines, r.n_chars, r.text) for r in views.rawdict_counts(docs).collect()]
    assert told(counts) == told((*k, len({b for i, p, b in blocks if (i, p) == k}), len(v), sum(map(len, v)), "".join(v)) for k, v in pages.items())


@pytest.mark.parametrize("name", ["text_rawdict", "text_words", "text_words_sorted", "text_plain", "text_trace"])
def test_a_text_is_laid_out_where_it_is_read(spark, sf_dir, name):
    assert "Exchange" not in queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
