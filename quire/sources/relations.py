"""Documents in a binary column as relations: one pass over the bytes per relation.

A document is one row and so one task's work; everything after it is keyed by (doc_id,
page_no) and can be dealt out anew.  A document that can't be read gives a row in
``diagnostics`` and none elsewhere.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quire.plans import arrow, layout, virtual
from quire.sources import document as dc
from quire.sources import inventory
from quire.sources.syntax import Name, Ref, Stream, write

SCHEMAS = {
    "documents": "doc_id long, version string, page_count int, revisions int, is_repaired boolean, metadata map<string,string>",
    "pages": "doc_id long, page_no int, num int, mb_x0 double, mb_y0 double, mb_x1 double, mb_y1 double, cb_x0 double, cb_y0 double, cb_x1 double, cb_y1 double, rotate int, content binary",
    "objects": "doc_id long, num int, kind string, value string, refs array<int>, is_stream boolean",
    "glyphs": "doc_id long, page_no int, seq int, unicode string, ox double, oy double, x0 double, y0 double, x1 double, y1 double, size double, font string",
    "rects": "doc_id long, page_no int, seq int, kind string, x0 double, y0 double, x1 double, y1 double",
    "toc": "doc_id long, ord int, level int, title string, page int",
    "links": "doc_id long, page_no int, x0 double, y0 double, x1 double, y1 double, uri string",
    "diagnostics": "doc_id long, offset long, kind string, detail string",
    "texts": "doc_id long, page_no int, text string",
    "words": "doc_id long, page_no int, line_no int, word_no int, word string, x0 double, y0 double, x1 double, y1 double",
}
#: Of the rows of a virtual page, from the bottom.
BASELINES = [virtual.HEIGHT - (virtual.MARGIN + k * virtual.LEADING) - 0.75 * virtual.SIZE for k in range(virtual.ROWS)]
#: Rows of a batch, and documents' bytes and glyphs after which one is given out.
BATCH_ROWS, BATCH_BYTES, BATCH_GLYPHS = 10_000, 4 << 20, 1 << 18


def _plain(value):
    if isinstance(value, Stream):
        return _plain(value.dict)
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, Ref):
        return {"ref": value.num}
    if isinstance(value, bytes):
        return {"hex": value.hex()}
    return "/" + value if isinstance(value, Name) else value


def _refs(value) -> list[int]:
    if isinstance(value, Ref):
        return [value.num]
    items = value.dict.values() if isinstance(value, Stream) else value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return [r for v in items for r in _refs(v)]


def _documents(i, d):
    yield i, d.version, len(d.pages()), d.revisions, d.repaired, d.metadata()


def _pages(i, d):
    for k, (num, page) in enumerate(d.pages()):
        media, crop, rotate = d.boxes(page)
        yield i, k, num, *media, *crop, rotate, d.content(page)


def _objects(i, d):
    for num in sorted(d.entries):
        v = d.get(Ref(num))
        if v is not None:
            inner = v.dict if isinstance(v, Stream) else v
            kind = str(inner.get("Type", "")) if isinstance(inner, dict) else type(v).__name__
            yield i, num, kind, json.dumps(_plain(v), sort_keys=True), _refs(v), isinstance(v, Stream)


def _on_device(d, page):
    """Maps user space to device space of the crop box, y down, with the page's rotation."""
    _, c, rotate = d.boxes(page)
    w, h = c[2] - c[0], c[3] - c[1]
    return lambda x, y: {0: (x - c[0], c[3] - y), 90: (y - c[1], x - c[0]), 180: (c[2] - x, y - c[1]), 270: (h - (y - c[1]), w - (x - c[0]))}.get(rotate, (x - c[0], c[3] - y)), c


def _rects(i, d):
    for k, (_, page) in enumerate(d.pages()):
        to, _ = _on_device(d, page)
        for seq, (x0, y0, x1, y1, kind) in enumerate(dc.interpret(d, page)[1]):
            (ax, ay), (bx, by) = to(x0, y0), to(x1, y1)
            yield i, k, seq, kind, min(ax, bx), min(ay, by), max(ax, bx), max(ay, by)


def _toc(i, d):
    for k, row in enumerate(d.outline()):
        yield i, k, *row


def _links(i, d):
    for k, (_, page) in enumerate(d.pages()):
        to, _ = _on_device(d, page)
        for r, uri in d.links(page):
            (ax, ay), (bx, by) = to(r[0], r[1]), to(r[2], r[3])
            yield i, k, min(ax, bx), min(ay, by), max(ax, bx), max(ay, by), uri


def _diagnostics(i, d):
    for _, page in d.pages():
        dc.interpret(d, page)
    for offset, kind, detail in d.problems:
        yield i, offset, kind, detail


MAKERS: dict[str, Callable] = {"documents": _documents, "pages": _pages, "objects": _objects, "rects": _rects, "toc": _toc, "links": _links, "diagnostics": _diagnostics}

for _name, (_make, _schema) in inventory.RELATIONS.items():
    MAKERS[_name], SCHEMAS[_name] = _make, _schema


class _Glyphs:
    """The glyphs of the pages of some documents within their crop boxes, in arrays: ``page``
    is a glyph's place in ``pages`` (doc_id, page_no), ``seq`` its number on its page."""

    def __init__(self):
        self.pages: list[tuple] = []
        self.runs: list[dc.Run] = []
        self.of: list[int] = []
        self.to: list[tuple] = []
        self.count = 0

    def add(self, i, d: dc.Document) -> None:
        found = [(k, d.boxes(page), dc.runs(d, page)[0]) for k, (_, page) in enumerate(d.pages())]
        for k, (_, c, rotate), shown in found:
            w, h = c[2] - c[0], c[3] - c[1]
            to = {90: (0, 1, -c[1], 1, 0, -c[0]), 180: (-1, 0, c[2], 0, 1, -c[1]), 270: (0, -1, h + c[1], -1, 0, w + c[0])}.get(rotate, (1, 0, -c[0], 0, -1, c[3]))
            self.of += [len(self.pages)] * len(shown)
            self.to.append((*to, c[0] - 1, c[1] - 1, c[2] + 1, c[3] + 1))
            self.pages.append((i, k))
            self.runs += shown
            self.count += sum(len(r.chars) for r in shown)

    def measured(self) -> None:
        """Arrays over the runs; ``uneven`` are those whose glyphs have widths of their own."""
        even = lambda v: v if isinstance(v, float) else np.nan
        rows = np.array([(r.x, r.y, r.ux, r.uy, r.size, len(r.chars), even(r.t), even(r.advance)) for r in self.runs], float)
        self.x, self.y, self.ux, self.uy, self.em, n, self.step, self.advance = rows.reshape(-1, 8).T
        self.n, self.in_page = n.astype(np.int64), np.array(self.of, np.int64)
        self.uneven = np.flatnonzero(np.isnan(self.step) | np.isnan(self.advance)).tolist()
        self.on = np.array(self.to, float).reshape(-1, 10)[self.in_page].T

    def all_inside(self) -> bool:
        """Whether the ends of all runs, and so all their glyphs, are within the crop boxes."""
        low, high = np.zeros(len(self.n)), (self.n - 1) * self.step
        for j in self.uneven:
            t = self.runs[j].t
            low[j], high[j] = (0.0, (self.n[j] - 1) * t) if isinstance(t, float) else (t.min(), t.max())
        ends = [(v + far * by, k) for far in (low, high) for v, by, k in ((self.x, self.ux, 6), (self.y, self.uy, 7))]
        return all(((self.on[k] <= v) & (v <= self.on[k + 2])).all() for v, k in ends)

    def place(self) -> None:
        self.measured()
        runs, n, x, y, ux, uy, size = self.runs, self.n, self.x, self.y, self.ux, self.uy, self.em
        a, b, c, d, e, f, *box = self.on
        of = np.repeat(np.arange(len(runs)), n)
        t, advance, first = arrow.ranges(np.zeros(len(runs), np.int64), n) * self.step[of], self.advance[of], np.cumsum(n) - n
        for j in self.uneven:
            for v, all_ in ((runs[j].t, t), (runs[j].advance, advance)):
                if not isinstance(v, float):
                    all_[first[j] : first[j] + n[j]] = v
        if all(isinstance(r.chars, str) for r in runs):
            data = np.frombuffer("".join([r.chars for r in runs]).encode("utf-8", "replace"), np.uint8)
            ends = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        else:
            chars = [c.encode("utf-8", "replace") for r in runs for c in r.chars]
            data, ends = np.frombuffer(b"".join(chars), np.uint8), np.append(0, np.cumsum([len(c) for c in chars]))
        if not self.all_inside():
            on_page = lambda v, step, low, high: (low[of] <= (w := v[of] + t * step[of])) & (w <= high[of])
            kept, width = np.flatnonzero(on_page(x, ux, box[0], box[2]) & on_page(y, uy, box[1], box[3])), np.diff(ends)
            data = data[arrow.ranges(ends[kept], width[kept])]
            ends = np.append(0, np.cumsum(width[kept]))
            t, advance, of = t[kept], advance[kept], of[kept]
        self.data, self.ends, self.size, self.run_of, self.page = data, ends, size[of], of, self.in_page[of]
        first = np.searchsorted(self.page, np.arange(len(self.pages) + 1))
        self.first = first
        self.seq = np.arange(len(of)) - first[self.page]
        # on the device: the origin, and the corners a quarter of the size below and three above
        self.ox, self.oy = (a * x + b * y + c)[of] + t * (a * ux + b * uy)[of], (d * x + e * y + f)[of] + t * (d * ux + e * uy)[of]
        ends_of = lambda o, low, high, by: (o + low[of], o + high[of] + advance * by[of])
        (ax, bx), (ay, by) = ends_of(self.ox, -0.25 * size * b, 0.75 * size * b, a), ends_of(self.oy, -0.25 * size * e, 0.75 * size * e, d)
        self.x0, self.y0, self.x1, self.y1 = np.minimum(ax, bx), np.minimum(ay, by), np.maximum(ax, bx), np.maximum(ay, by)

    def ids(self, pages: np.ndarray) -> dict:
        ids = np.array(self.pages, np.int64).reshape(-1, 2)[pages]
        return {"doc_id": ids[:, 0], "page_no": ids[:, 1].astype(np.int32)}

    def unicode(self) -> pa.Array:
        return arrow.strings(self.data, self.ends)


def _glyphs(g: _Glyphs) -> dict:
    g.place()
    font = pa.array([r.font for r in g.runs], pa.string()).take(pa.array(g.run_of))
    return g.ids(g.page) | {"seq": g.seq.astype(np.int32), "unicode": g.unicode(), "ox": g.ox, "oy": g.oy, "x0": g.x0, "y0": g.y0, "x1": g.x1, "y1": g.y1, "size": g.size, "font": font}


def _texts(g: _Glyphs) -> dict:
    """The glyphs of a page in paint order as one string; a page without glyphs has none."""
    g.measured()
    if g.all_inside():
        texts: dict[int, list[str]] = {}
        for page, r in zip(g.of, g.runs, strict=True):
            texts.setdefault(page, []).append(r.chars if isinstance(r.chars, str) else "".join(r.chars))
        joined = pa.array(["".join(t).encode("utf-8", "replace") for t in texts.values()], pa.binary()).cast(pa.string())
        return g.ids(np.array(list(texts), np.int64)) | {"text": joined}
    g.place()
    pages = np.flatnonzero(np.diff(g.first))
    return g.ids(pages) | {"text": arrow.strings(g.data, np.append(g.ends[g.first[pages]], len(g.data)))}


def _words(g: _Glyphs) -> dict:
    g.place()
    page, made = layout.words_of(g.page, g.seq, g.unicode(), g.ox, g.oy, g.x0, g.y0, g.x1, g.y1, g.size)
    return g.ids(page) | made


GLYPH_MAKERS: dict[str, Callable[[_Glyphs], dict]] = {"glyphs": _glyphs, "texts": _texts, "words": _words}


def relation(files: DataFrame, name: str, id_col: str = "doc_id", content_col: str = "content", mode: str = "lenient") -> DataFrame:
    """A relation of ``SCHEMAS`` from documents in a binary column; null contents give none.

    mode ``strict`` raises at the first fault instead of mending it.
    """
    make, schema = MAKERS.get(name), StructType.fromDDL(SCHEMAS[name])
    fields = to_arrow_schema(schema)

    def contents(batch: pa.RecordBatch):
        return ((i, c.as_py()) for i, c in zip(batch.column("i").to_pylist(), batch.column("c"), strict=True))

    def opened(i, content, use):
        try:
            return use(i, dc.Document(content, strict=mode == "strict"))
        except Exception as e:
            if mode == "strict":
                raise
            return [(i, 0, "unreadable", f"{type(e).__name__}: {e}")] if name == "diagnostics" else []

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([list(v.items()) for v in c] if pa.types.is_map(f.type) else c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    def by_row(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for i, content in contents(batch):
            found = opened(i, content, lambda i, d: list(make(i, d)))
            held += len(content) if found else 0
            for a in range(0, len(found), BATCH_ROWS):
                rows += found[a : a + BATCH_ROWS]
                if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield table(rows)
                    rows, held = [], 0
        if rows:
            yield table(rows)

    def by_glyph(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        g = _Glyphs()
        for i, content in contents(batch):
            opened(i, content, g.add)
            if g.count >= BATCH_GLYPHS:
                yield arrow.batch(GLYPH_MAKERS[name](g))
                g = _Glyphs()
        if g.count:
            yield arrow.batch(GLYPH_MAKERS[name](g))

    rows = files.select(F.col(id_col).cast("long").alias("i"), F.col(content_col).alias("c")).filter("c is not null")
    return arrow.mapped(rows, by_glyph if name in GLYPH_MAKERS else by_row, schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, content) of the files under a path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "content")


def written_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, content): a document of each text's virtual pages (doc_id, text)."""

    dealt = docs.repartition("doc_id")  # a file may be one task's, and documents take long

    def make(y: virtual.Layout):
        first, texts = np.flatnonzero(y.n == 0), y.texts().to_pylist()
        out = []
        for a, b in zip(first, np.append(first[1:], len(texts)), strict=True):
            out.append(dc.from_pages([[(virtual.MARGIN, BASELINES[k], t) for k, t in enumerate(texts[at : min(at + virtual.ROWS, b)]) if t] for at in range(a, b, virtual.ROWS)]))
        return y.doc[first], {"content": pa.array(out, pa.binary())}

    return virtual.laid_out(dealt, "content binary", make)


__all__ = ["MAKERS", "SCHEMAS", "read", "relation", "write", "written_documents"]
