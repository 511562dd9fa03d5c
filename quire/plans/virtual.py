"""Virtual pages: plain texts laid out in a fixed-width font, relation by relation.

Every text line is cut at ``COLS`` characters, ``ROWS`` lines make a page.  A text is one
row and its whole layout follows from it, so every relation comes from one pass over the
texts, in arrays of bytes and places, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from quire.plans import arrow

WIDTH, HEIGHT, MARGIN = 612.0, 792.0, 72.0
SIZE, ADVANCE, LEADING = 11.0, 6.6, 14.0
COLS, ROWS = 70, 46
#: Bytes of text that are laid out at once; a longer text is laid out alone.
PART_BYTES = 1 << 20


class Layout:
    """The lines of some texts: ``doc`` (the text's place), ``n`` (number in its text),
    ``page``, ``row``, ``src_line``; ``c0`` and ``c1`` are their ends in characters, ``b0``
    and ``b1`` in bytes of ``data``."""

    def __init__(self, texts: pa.Array):
        self.data, ends = arrow.string_parts(texts)
        data, n_docs = self.data, len(ends) - 1
        self.feeds = np.flatnonzero(data == 10)
        before = np.searchsorted(self.feeds, ends)
        first = np.arange(n_docs + 1) + before  # the first source line of each text
        begin, end = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
        opens, closes = np.zeros(len(begin), bool), np.zeros(len(begin), bool)
        opens[first[:-1]] = closes[first[1:] - 1] = True
        begin[opens], begin[~opens] = ends[:-1], self.feeds + 1
        end[closes], end[~closes] = ends[1:], self.feeds
        lead = (data & 0xC0) != 0x80
        self.chars = np.concatenate([[0], np.cumsum(lead)])  # characters before a byte
        self.bytes = np.append(np.flatnonzero(lead), len(data))  # bytes before a character
        c_begin, c_end = self.chars[begin], self.chars[end]
        pieces = np.maximum(-(-(c_end - c_begin) // COLS), 1)
        src = np.repeat(np.arange(len(begin)), pieces)
        self.c0 = arrow.ranges(np.zeros(len(begin), np.int64), pieces) * COLS + c_begin[src]
        self.c1 = np.minimum(self.c0 + COLS, c_end[src])
        self.b0, self.b1 = self.bytes[self.c0], self.bytes[self.c1]
        of_doc = np.repeat(np.arange(n_docs), np.diff(first))
        self.doc = of_doc[src]
        self.src_line = src - first[self.doc]
        self.n = np.arange(len(src)) - np.searchsorted(self.doc, np.arange(n_docs))[self.doc]
        self.page, self.row = self.n // ROWS, self.n % ROWS

    def words(self) -> None:
        """Adds what stands between spaces: ``w0`` and ``w1`` are the ends of the words in
        bytes, ``of`` is a word's line, ``word_no`` its number there."""
        ink = (self.data != 32) & (self.data != 10)
        cut = np.zeros(len(ink) + 1, bool)
        cut[self.b0] = cut[0] = cut[-1] = True
        after = np.concatenate([[False], ink])
        before = np.concatenate([ink, [False]])
        self.ink = ink
        self.w0 = np.flatnonzero(before & (~after | cut))
        self.w1 = np.flatnonzero(after & (~before | cut))
        self.of = np.searchsorted(self.b0, self.w0, "right") - 1
        count = np.bincount(self.of, minlength=len(self.b0))
        self.word_no = arrow.ranges(np.zeros(len(count), np.int64), count)
        self.inked = np.flatnonzero(count)

    def number(self) -> None:
        """Adds block_no and line_no (in the block) of lines with ink, and ``new_page`` and
        ``new_block`` over these: a block ends where the next line with ink is further than
        the one below."""
        self.words()
        k, size = self.inked, len(self.b0)
        doc, page, row = self.doc[k], self.page[k], self.row[k]
        self.new_page = np.ones(len(k), bool)
        self.new_page[1:] = (doc[1:] != doc[:-1]) | (page[1:] != page[:-1])
        self.new_block = self.new_page.copy()
        self.new_block[1:] |= row[1:] - row[:-1] > 1
        block = np.cumsum(self.new_block)
        self.block_no, self.line_no = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.block_no[k] = block - block[self.new_page][np.cumsum(self.new_page) - 1]
        self.line_no[k] = row - row[self.new_block][block - 1]

    def x(self, chars: np.ndarray) -> np.ndarray:
        return MARGIN + chars * ADVANCE

    def y0(self, rows: np.ndarray) -> np.ndarray:
        return MARGIN + rows * LEADING

    def texts(self, lines: np.ndarray | None = None) -> pa.Array:
        """The texts of all lines, or of some, in order."""
        if lines is None:
            return arrow.strings(self.data[self.data != 10], np.append(self.b0 - np.searchsorted(self.feeds, self.b0), len(self.data) - len(self.feeds)))
        size = self.b1[lines] - self.b0[lines]
        return arrow.strings(self.data[arrow.ranges(self.b0[lines], size)], np.concatenate([[0], np.cumsum(size)]))

    def boxes(self, lines: np.ndarray) -> dict[str, np.ndarray]:
        y0 = self.y0(self.row[lines])
        return {"x0": np.full(len(lines), MARGIN), "y0": y0, "x1": self.x(self.c1[lines] - self.c0[lines]), "y1": y0 + SIZE}


def laid_out(docs: DataFrame, columns: str, make: Callable[[Layout], tuple[np.ndarray, dict]], part_bytes: int = PART_BYTES, kept: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``kept`` of (doc_id, text) and those that ``make`` gives: it returns each
    row's place among the texts and its columns.  Null texts have no rows."""
    schema = StructType([docs.schema[c] for c in kept] + StructType.fromDDL(columns).fields)
    names = [f.name for f in schema.fields]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        table = batch.filter(batch.column("text").is_valid())
        _, ends = arrow.string_parts(table.column("text"))
        at = 0
        while at < len(ends) - 1:
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + part_bytes, "right")) - 1)
            part = table.slice(at, stop - at)
            place, made = make(Layout(part.column("text")))
            place = pa.array(place)
            if len(place):
                yield arrow.batch({n: made[n] if n in made else part.column(n).take(place) for n in names})
            at = stop

    return arrow.mapped(docs.select(*dict.fromkeys([*kept, "text"])), run, schema)


def _i(v: np.ndarray) -> np.ndarray:
    return v.astype(np.int32)


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, page_no, row, src_line, text, x0, y0, x1, y1): every laid-out line, blank
    ones too; a null text has none."""

    def make(y: Layout):
        every = np.arange(len(y.b0))
        return y.doc, {"page_no": _i(y.page), "row": _i(y.row), "src_line": _i(y.src_line), "text": y.texts(), **y.boxes(every)}

    return laid_out(docs, "page_no int, row int, src_line int, text string, x0 double, y0 double, x1 double, y1 double", make)


def _numbered(y: Layout) -> dict:
    y.number()
    k = y.inked
    return {"page_no": _i(y.page[k]), "row": _i(y.row[k]), "src_line": _i(y.src_line[k]), "text": y.texts(k), **y.boxes(k), "block_no": _i(y.block_no[k]), "line_no": _i(y.line_no[k])}


def numbered_lines(docs: DataFrame) -> DataFrame:
    """Lines with ink, with block_no and line_no (in the block): a block ends where the
    next line with ink is further than the one below."""

    def make(y: Layout):
        out = _numbered(y)
        return y.doc[y.inked], out

    return laid_out(docs, "page_no int, row int, src_line int, text string, x0 double, y0 double, x1 double, y1 double, block_no int, line_no int", make)


def pages(docs: DataFrame) -> DataFrame:
    """(doc_id, page_no, ls): the numbered lines of a page, in order, as an array."""

    def make(y: Layout):
        out = _numbered(y)
        first = np.flatnonzero(y.new_page)
        page_no = out.pop("page_no")[first]
        return y.doc[y.inked][first], {"page_no": page_no, "ls": arrow.lists(np.append(first, len(y.inked)), arrow.structs(out))}

    return laid_out(docs, "page_no int, ls array<struct<row:int,src_line:int,text:string,x0:double,y0:double,x1:double,y1:double,block_no:int,line_no:int>>", make)


def documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ls): the texts of all laid-out lines, in order and blank ones too."""

    def make(y: Layout):
        first = np.flatnonzero(y.n == 0)
        return y.doc[first], {"ls": arrow.lists(np.append(first, len(y.n)), y.texts())}

    return laid_out(docs, "ls array<string>", make, kept=("doc_id", "text"))


def words(docs: DataFrame, numbered: bool = True) -> DataFrame:
    """(doc_id, page_no, x0, y0, x1, y1, word, block_no, line_no, word_no)."""

    def make(y: Layout):
        y.number() if numbered else y.words()
        k = y.of
        c0, y0 = y.c0[k], y.y0(y.row[k])
        text = arrow.strings(y.data[y.ink], np.append(0, np.cumsum(y.w1 - y.w0)))
        block, line = (y.block_no[k], y.line_no[k]) if numbered else (np.zeros(len(k)), y.row[k])
        return y.doc[k], {"page_no": _i(y.page[k]), "x0": y.x(y.chars[y.w0] - c0), "y0": y0, "x1": y.x(y.chars[y.w1] - c0), "y1": y0 + SIZE, "word": text, "block_no": _i(block), "line_no": _i(line), "word_no": _i(y.word_no)}

    return laid_out(docs, "page_no int, x0 double, y0 double, x1 double, y1 double, word string, block_no int, line_no int, word_no int", make)


def blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, page_no, x0, y0, x1, y1, text, block_no, block_type)."""

    def make(y: Layout):
        y.number()
        k, first = y.inked, np.flatnonzero(y.new_block)
        at, last = k[first], k[np.append(first[1:], len(k)) - 1] if len(k) else k
        size = y.b1[k] - y.b0[k] + 1  # a line feed between lines, and one too many at the end
        data = np.full(size.sum(), 10, np.uint8)
        ends = np.cumsum(size)
        inner = np.ones(len(data), bool)
        inner[ends - 1] = False
        data[inner] = y.data[arrow.ranges(y.b0[k], size - 1)]
        stop = ends[np.append(first[1:], len(k)) - 1] if len(k) else ends
        drop = np.ones(len(data), bool)
        drop[stop - 1] = False
        text = arrow.strings(data[drop], np.append(0, stop - np.arange(1, len(stop) + 1)))
        x1 = np.maximum.reduceat(y.c1[k] - y.c0[k], first) if len(k) else np.zeros(0)
        return y.doc[at], {"page_no": _i(y.page[at]), "x0": np.full(len(at), MARGIN), "y0": y.y0(y.row[at]), "x1": y.x(x1), "y1": y.y0(y.row[last]) + SIZE, "text": text, "block_no": _i(y.block_no[at]), "block_type": np.zeros(len(at), np.int32)}

    return laid_out(docs, "page_no int, x0 double, y0 double, x1 double, y1 double, text string, block_no int, block_type int", make)


def inked_chars(y: Layout) -> tuple[np.ndarray, np.ndarray, dict]:
    """(line, number of each line's characters, (char_no, c, x0, y0, x1, y1)) of the
    characters of the lines with ink."""
    y.number()
    k = y.inked
    count = y.c1[k] - y.c0[k]
    of = np.repeat(k, count)
    c = arrow.ranges(y.c0[k], count)
    size = y.bytes[c + 1] - y.bytes[c]
    text = arrow.strings(y.data[arrow.ranges(y.bytes[c], size)], np.append(0, np.cumsum(size)))
    char_no = c - y.c0[of]
    x0, y0 = y.x(char_no), y.y0(y.row[of])
    return of, count, {"char_no": _i(char_no), "c": text, "x0": x0, "y0": y0, "x1": x0 + ADVANCE, "y1": y0 + SIZE}


def chars(docs: DataFrame) -> DataFrame:
    """(doc_id, page_no, block_no, line_no, char_no, c, x0, y0, x1, y1)."""

    def make(y: Layout):
        of, _, out = inked_chars(y)
        return y.doc[of], {"page_no": _i(y.page[of]), "block_no": _i(y.block_no[of]), "line_no": _i(y.line_no[of]), **out}

    return laid_out(docs, "page_no int, block_no int, line_no int, char_no int, c string, x0 double, y0 double, x1 double, y1 double", make, PART_BYTES // 4)
