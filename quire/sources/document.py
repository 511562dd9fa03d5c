"""One document: cross-reference tables, repair, object lookup, page tree, content streams."""

from __future__ import annotations

import codecs
import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from quire.sources import filters
from quire.sources.crypto import Handler
from quire.sources.syntax import Keyword, Name, Parser, Ref, Stream, SyntaxProblem, text_of, write

INHERITED = ("MediaBox", "CropBox", "Rotate", "Resources")
LETTER = [0, 0, 612, 792]
_ENTRY = re.compile(rb"[\0\t\n\f\r ]*(\d+)[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+([nf])(?![^\0\t\n\f\r ()<>\[\]{}/%])")


class Document:
    """A parsed document.  ``problems`` lists (offset, kind, detail) of what was mended."""

    def __init__(self, data: bytes, strict: bool = False, password: bytes = b""):
        self.data, self.problems, self.cache = data, [], {}
        self.handler: Handler | None = None
        self.password = password
        self.entries: dict[int, tuple] = {}
        self.trailer: dict = {}
        self.revisions, self.repaired = 0, False
        head = re.search(rb"%PDF-(\d\.\d)", data[:1024])
        self.version, self.shift = (head[1].decode(), head.start()) if head else ("", 0)
        try:
            self._chain()
            self._unlock()
            self._gate()
        except (SyntaxProblem, ValueError, KeyError, IndexError, RecursionError, zlib.error) as e:
            if strict:
                raise
            self._repair(str(e))

    # cross references
    def _chain(self) -> None:
        at = self.data.rfind(b"startxref", max(0, len(self.data) - 2048))
        if at < 0:
            raise SyntaxProblem("no startxref")
        todo, seen = [Parser(self.data, at + 9).object() + self.shift], set()
        while todo:
            at = todo.pop(0)
            if at in seen or not 0 <= at < len(self.data):
                if at in seen:
                    break
                raise SyntaxProblem("a cross-reference offset is out of range")
            seen.add(at)
            self.revisions += 1
            p = Parser(self.data, at)
            p.skip()
            trailer = self._table(p) if self.data.startswith(b"xref", p.at) else self._stream(p)
            for k, v in trailer.items():
                self.trailer.setdefault(k, v)
            if isinstance(trailer.get("XRefStm"), int):
                self._stream(Parser(self.data, trailer["XRefStm"] + self.shift))
            if isinstance(trailer.get("Prev"), int):
                todo.append(trailer["Prev"] + self.shift)

    def _table(self, p: Parser) -> dict:
        p.at += 4
        while True:
            word = p.object(refs=False)
            if word == "trailer":
                return p.object()
            first, count = word, p.object(refs=False)
            for num in range(first, first + count):
                if m := _ENTRY.match(p.data, p.at):
                    p.at, offset, gen, kind = m.end(), int(m[1]), int(m[2]), m[3].decode()
                else:
                    offset, gen, kind = p.object(refs=False), p.object(refs=False), p.object(refs=False)
                if kind == "n":
                    self.entries.setdefault(num, ("at", offset + self.shift, gen))
                else:
                    self.entries.setdefault(num, ("free",))

    def _stream(self, p: Parser) -> dict:
        _, s = p.indirect()
        if not isinstance(s, Stream):
            raise SyntaxProblem("no cross-reference stream")
        rows = self.decoded(s)[0]
        w = s.dict["W"]
        index = s.dict.get("Index") or [0, s.dict["Size"]]
        nums = [n for a, c in zip(index[::2], index[1::2]) for n in range(a, a + c)]
        for k, num in enumerate(nums):
            row, fields, at = rows[k * sum(w) : (k + 1) * sum(w)], [], 0
            for n in w:
                fields.append(int.from_bytes(row[at : at + n], "big"))
                at += n
            kind = fields[0] if w[0] else 1
            entry = ("at", fields[1] + self.shift, fields[2]) if kind == 1 else ("in", fields[1], fields[2]) if kind == 2 else ("free",)
            self.entries.setdefault(num, entry)
        return s.dict

    def _unlock(self) -> None:
        """Sets up decryption where the trailer asks for it; a wrong password leaves strings
        and streams as they are and ``handler.role`` at None."""
        encrypt = self.get(self.trailer.get("Encrypt"))
        if isinstance(encrypt, dict):
            ids = self.get(self.trailer.get("ID"))
            handler = Handler(encrypt, ids[0] if isinstance(ids, list) and ids else b"", self.password)
            self.cache, self.handler = {}, handler

    def _gate(self) -> None:
        root = self.get(self.trailer.get("Root"))
        if not isinstance(root, dict) or not isinstance(self.get(root.get("Pages")), dict):
            raise SyntaxProblem("no catalog or pages")

    def _repair(self, why: str) -> None:
        """Finds objects by scanning for ``N G obj``; the last of a number wins."""
        self.repaired, self.cache, self.entries = True, {}, {}
        self.problems.append((0, "repair", why))
        for m in re.finditer(rb"(?<!\d)(\d{1,10})[\0\t\n\f\r ]+(\d{1,5})[\0\t\n\f\r ]+obj\b", self.data):
            self.entries[int(m[1])] = ("at", m.start(), int(m[2]))
        for m in re.finditer(rb"trailer", self.data):
            try:
                found = Parser(self.data, m.end()).object()
                if isinstance(found, dict):
                    self.trailer |= found
            except SyntaxProblem:
                continue
        for num in list(self.entries):
            o = self.get(Ref(num))
            if isinstance(o, Stream) and o.dict.get("Type") == "ObjStm":
                for k, inner in enumerate(self._members(num)):
                    self.entries.setdefault(inner[0], ("in", num, k))
            if isinstance(o, Stream) and o.dict.get("Type") == "XRef" and "Root" in o.dict:
                self.trailer.setdefault("Root", o.dict["Root"])
        root = self.get(self.trailer.get("Root"))
        if not isinstance(root, dict) or root.get("Type") != "Catalog":
            for num in sorted(self.entries):
                o = self.get(Ref(num))
                if isinstance(o, dict) and o.get("Type") == "Catalog":
                    self.trailer["Root"] = Ref(num)

    # objects
    def get(self, value, depth: int = 0):
        """What a value stands for: references are followed, dangling ones are None."""
        while isinstance(value, Ref):
            if depth > 256:
                return None
            value, depth = self._load(value.num), depth + 1
        return value

    def _load(self, num: int):
        if num in self.cache:
            return self.cache[num]
        self.cache[num] = None  # a cycle finds nothing
        entry, out = self.entries.get(num, ("free",)), None
        try:
            if entry[0] == "at":
                ref, out = Parser(self.data, entry[1]).indirect(self.get)
                if ref.num != num:
                    raise SyntaxProblem(f"object {num} is not at its place")
                locked = self.trailer.get("Encrypt")
                if self.handler and self.handler.role and not (isinstance(locked, Ref) and locked.num == num):
                    out = self.handler.open(ref, out)
            elif entry[0] == "in":
                members = self._members(entry[1])
                out = next((v for n, v in members if n == num), None)
        except (SyntaxProblem, ValueError, KeyError, IndexError) as e:
            self.problems.append((entry[1] if len(entry) > 1 else 0, "object", str(e)))
            if not self.repaired and entry[0] == "at":
                m = list(re.finditer(rb"(?<!\d)%d[\0\t\n\f\r ]+\d+[\0\t\n\f\r ]+obj\b" % num, self.data))
                if m:
                    out = Parser(self.data, m[-1].start()).indirect(self.get)[1]
        self.cache[num] = out
        return out

    def _members(self, num: int) -> list[tuple[int, object]]:
        key = ("members", num)
        if key not in self.cache:
            s = self._load(num)
            body = self.decoded(s)[0]
            p, heads = Parser(body), []
            for _ in range(s.dict["N"]):
                heads.append((p.object(refs=False), p.object(refs=False)))
            self.cache[key] = [(n, Parser(body, s.dict["First"] + at).object()) for n, at in heads]
        return self.cache[key]

    def decoded(self, s: Stream) -> tuple[bytes, str | None]:
        as_list = lambda v: [] if v is None else v if isinstance(v, list) else [v]
        names = [str(self.get(n)) for n in as_list(self.get(s.dict.get("Filter", s.dict.get("F"))))]
        parms = [{k: self.get(v) for k, v in d.items()} if isinstance(d := self.get(x), dict) else {} for x in as_list(self.get(s.dict.get("DecodeParms", s.dict.get("DP"))))]
        return filters.decode(s.raw, names, parms)

    # pages
    def pages(self) -> list[tuple[int, dict]]:
        """(object number, dictionary with inherited attributes) of the leaves in order."""
        out, seen = [], set()
        root = self.get(self.trailer.get("Root"))
        todo = [(root.get("Pages"), {})] if isinstance(root, dict) else []
        while todo:
            ref, above = todo.pop()
            node = self.get(ref)
            num = ref.num if isinstance(ref, Ref) else 0
            if not isinstance(node, dict) or num in seen:
                continue
            if num:
                seen.add(num)
            have = above | {k: node[k] for k in INHERITED if k in node}
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                todo += [(k, have) for k in reversed(kids)]
            else:
                out.append((num, node | have))
        if not out:
            out = [(n, o) for n in sorted(self.entries) if isinstance(o := self.get(Ref(n)), dict) and o.get("Type") == "Page"]
        return out

    def boxes(self, page: dict) -> tuple[list[float], list[float], int]:
        """Media box, crop box within it, and rotation of a page."""
        box = lambda v: [min(v[0], v[2]), min(v[1], v[3]), max(v[0], v[2]), max(v[1], v[3])]
        read = lambda k: box([float(self.get(x)) for x in v]) if isinstance(v := self.get(page.get(k)), list) and len(v) == 4 else None
        media = read("MediaBox") or [float(x) for x in LETTER]
        crop = read("CropBox") or media
        crop = [max(crop[0], media[0]), max(crop[1], media[1]), min(crop[2], media[2]), min(crop[3], media[3])]
        return media, crop if crop[0] < crop[2] and crop[1] < crop[3] else media, int(self.get(page.get("Rotate")) or 0) % 360

    def content(self, page: dict) -> bytes:
        c = self.get(page.get("Contents"))
        parts = [self.get(x) for x in c] if isinstance(c, list) else [c]
        return b"\n".join(self.decoded(s)[0] for s in parts if isinstance(s, Stream))

    def metadata(self) -> dict[str, str]:
        info = self.get(self.trailer.get("Info"))
        return {k: text_of(x) for k, v in info.items() if isinstance(x := self.get(v), bytes)} if isinstance(info, dict) else {}

    def outline(self) -> list[tuple[int, str, int]]:
        """(level, title, page index or -1) in pre-order."""
        index = {num: k for k, (num, _) in enumerate(self.pages())}
        out, seen = [], set()

        def walk(ref, level: int) -> None:
            while isinstance(ref, Ref) and ref.num not in seen and level <= 200:
                seen.add(ref.num)
                node = self.get(ref)
                if not isinstance(node, dict):
                    return
                dest = self.get(node.get("Dest")) or (self.get(node.get("A")) or {}).get("D")
                dest = self.get(dest)
                page = index.get(dest[0].num, -1) if isinstance(dest, list) and dest and isinstance(dest[0], Ref) else -1
                out.append((level, text_of(self.get(node.get("Title")) or b""), page))
                walk(node.get("First"), level + 1)
                ref = node.get("Next")

        root = self.get(self.trailer.get("Root")) or {}
        walk((self.get(root.get("Outlines")) or {}).get("First"), 1)
        return out

    def links(self, page: dict) -> list[tuple[list[float], str]]:
        out = []
        for a in self.get(page.get("Annots")) or []:
            a = self.get(a)
            if isinstance(a, dict) and a.get("Subtype") == "Link":
                action = self.get(a.get("A")) or {}
                uri = self.get(action.get("URI"))
                out.append(([float(self.get(x)) for x in self.get(a["Rect"])], text_of(uri) if isinstance(uri, bytes) else ""))
        return out


@dataclass
class Glyph:
    unicode: str
    x: float
    y: float
    advance: float
    size: float
    font: str


@dataclass
class Run:
    """The glyphs of one shown string: ``chars`` is a string where each glyph is one character,
    else a list.  Glyph k stands at (x + t[k] * ux, y + t[k] * uy); where all have one width,
    ``t`` is the step from one to the next and ``advance`` a number."""

    chars: str | list[str]
    x: float
    y: float
    ux: float
    uy: float
    t: float | np.ndarray
    advance: float | np.ndarray
    size: float
    font: str

    def glyphs(self) -> list[Glyph]:
        t = (np.arange(len(self.chars)) * self.t if isinstance(self.t, float) else self.t).tolist()
        advance = [self.advance] * len(t) if isinstance(self.advance, float) else self.advance.tolist()
        return [Glyph(c, self.x + k * self.ux, self.y + k * self.uy, a, self.size, self.font) for c, k, a in zip(self.chars, t, advance, strict=True)]


def _mul(m, n):
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


class Font:
    """Codes to characters and widths: ToUnicode first, then the simple encoding."""

    def __init__(self, doc: Document, d: dict):
        self.name = str(doc.get(d.get("BaseFont")) or "")
        self.wide = d.get("Subtype") == "Type0"
        self.map: dict[int, str] = {}
        self.tables: tuple | None = None
        s = doc.get(d.get("ToUnicode"))
        if isinstance(s, Stream):
            self._cmap(doc.decoded(s)[0])
        self.first = int(doc.get(d.get("FirstChar")) or 0)
        self.widths = [float(doc.get(w) or 0) for w in doc.get(d.get("Widths")) or []]
        self.default = 600.0 if "Courier" in self.name or not self.widths else 0.0
        if self.wide:
            child = doc.get((doc.get(d.get("DescendantFonts")) or [None])[0]) or {}
            self.default = float(doc.get(child.get("DW")) or 1000)

    def _cmap(self, body: bytes) -> None:
        hexes = lambda b: [bytes.fromhex(x.decode()) for x in re.findall(rb"<([0-9A-Fa-f]*)>", b)]
        for block in re.findall(rb"beginbfchar(.*?)endbfchar", body, re.S):
            h = hexes(block)
            self.map |= {int.from_bytes(a, "big"): b.decode("utf-16-be", "replace") for a, b in zip(h[::2], h[1::2])}
        for block in re.findall(rb"beginbfrange(.*?)endbfrange", body, re.S):
            for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(<[0-9A-Fa-f]+>|\[.*?\])", block, re.S):
                lo, hi, to = int(a, 16), int(b, 16), hexes(c)
                for k in range(lo, min(hi, lo + 65535) + 1):
                    if c.startswith(b"["):
                        self.map[k] = to[k - lo].decode("utf-16-be", "replace") if k - lo < len(to) else ""
                    else:
                        base = to[0].decode("utf-16-be", "replace")
                        self.map[k] = base[:-1] + chr(ord(base[-1]) + k - lo)


    def shown(self, raw: bytes) -> tuple[str | list[str], float | np.ndarray]:
        """(characters, widths) of a string: the characters are a string where each code is one,
        and the widths a number where all of the font are the same."""
        if self.wide:
            codes = [int.from_bytes(raw[i : i + 2], "big") for i in range(0, len(raw) - 1, 2)]
            return [c if (c := self.map.get(k)) not in (None, "\0") else "�" for k in codes], self.default
        if self.tables is None:
            self.tables = _codes(tuple(sorted((k, c) for k, c in self.map.items() if k < 256)), self.first, tuple(self.widths), self.default)
        chars, widths = self.tables
        text = codecs.charmap_decode(raw, "strict", chars)[0] if isinstance(chars, str) else [chars[k] for k in raw]
        return text, widths if isinstance(widths, float) else widths[np.frombuffer(raw, np.uint8)]


@lru_cache(maxsize=256)
def _codes(named: tuple, first: int, known: tuple, default: float) -> tuple[str | list[str], float | np.ndarray]:
    """Characters and widths of the 256 codes of a simple font."""
    names = dict(named)
    chars = [c if (c := names.get(k)) not in (None, "\0") else bytes([k]).decode("cp1252", "replace") for k in range(256)]
    widths = [known[k - first] if 0 <= k - first < len(known) else default for k in range(256)]
    plain = all(len(c) == 1 and c != "\ufffe" for c in chars)
    return "".join(chars) if plain else chars, widths[0] if len(set(widths)) == 1 else np.array(widths)


_TOKEN = re.compile(
    rb"[\0\t\n\f\r ]*(?:([+-]?\d+(?:\.\d*)?|[+-]?\.\d+)(?![^\0\t\n\f\r ()<>\[\]{}/%])|\(([^()\\]*)\)|<([0-9A-Fa-f]*)>|([A-Za-z'\"][A-Za-z0-9'\"*]*)(?![^\0\t\n\f\r ()<>\[\]{}/%]))"
)
_VALUES = (b"true", b"false", b"null")
#: A string shown at a place of its own, as most writers put it.
_PLACED = re.compile(
    rb"[\0\t\n\f\r ]*" + rb"([+-]?\d+(?:\.\d*)?)[\0\t\n\f\r ]+" * 6 + rb"Tm[\0\t\n\f\r ]*(?:\(([^()\\]*)\)|<((?:[0-9A-Fa-f]{2})*)>)[\0\t\n\f\r ]*Tj(?![^\0\t\n\f\r ()<>\[\]{}/%])"
)


@lru_cache(maxsize=4096)
def _number(word: bytes) -> float | int:
    return float(word) if b"." in word else int(word)


def _operators(p: Parser):
    """(operator, operands) of a content stream until its end or a fault; ``p.at`` may be
    moved in between.  Numbers, plain strings and words are told by one pattern."""
    args: list = []
    while True:
        if not args and (m := _PLACED.match(p.data, p.at)):
            p.at = m.end()
            *matrix, plain, coded = m.groups()
            yield "Tm", [*map(_number, matrix)]
            yield "Tj", [bytes.fromhex(coded.decode()) if plain is None else plain]
            continue
        m = _TOKEN.match(p.data, p.at)
        kind = m.lastindex if m else 0
        if kind == 1:
            p.at = m.end()
            args.append(_number(m[1]))
        elif kind == 2:
            p.at = m.end()
            args.append(m[2])
        elif kind == 3:
            p.at, word = m.end(), m[3]
            args.append(bytes.fromhex((word + b"0" * (len(word) % 2)).decode()))
        elif kind == 4 and m[4] not in _VALUES:
            p.at = m.end()
            yield m[4].decode("latin-1"), args
            args = []
        else:
            try:
                item = p.object(refs=False)
            except SyntaxProblem:
                return
            if isinstance(item, Keyword):
                yield str(item), args
                args = []
            else:
                args.append(item)


def interpret(doc: Document, page: dict) -> tuple[list[Glyph], list[tuple]]:
    """Glyphs and rectangles (x0, y0, x1, y1, paint) of a page in user space, in paint order."""
    shown, rects = runs(doc, page)
    return [g for r in shown for g in r.glyphs()], rects


def _font(doc: Document, ref) -> Font | None:
    """The font of a reference, read once a document."""
    key = ("font", ref.num) if isinstance(ref, Ref) else None
    if key not in doc.cache or key is None:
        d = doc.get(ref)
        made = Font(doc, d) if isinstance(d, dict) else None
        if key is None:
            return made
        doc.cache[key] = made
    return doc.cache[key]


def runs(doc: Document, page: dict, content: bytes | None = None, resources: dict | None = None, ctm=(1, 0, 0, 1, 0, 0), depth: int = 0) -> tuple[list[Run], list[tuple]]:
    """Shown strings and rectangles (x0, y0, x1, y1, paint) of a page in user space, in paint order."""
    content = doc.content(page) if content is None else content
    resources = resources or doc.get(page.get("Resources")) or {}
    fonts = {k: f for k, ref in (doc.get(resources.get("Font")) or {}).items() if (f := _font(doc, ref)) is not None}
    p, out, rects, path = Parser(content), [], [], []
    stack: list = []
    state = {"ctm": tuple(ctm), "font": None, "size": 1.0, "tc": 0.0, "tw": 0.0, "th": 1.0, "tl": 0.0, "rise": 0.0}
    tm = lm = (1, 0, 0, 1, 0, 0)

    def show(raw: bytes) -> None:
        nonlocal tm
        font = state["font"]
        if font is None:
            return
        if not isinstance(raw, bytes):
            raise TypeError("no string is shown")
        chars, widths = font.shown(raw)
        if not len(chars):
            return
        size, th, tc, tw, rise = state["size"], state["th"], state["tc"], state["tw"], state["rise"]
        a, b, c, d, e, f = _mul(tm, state["ctm"])
        advance = widths / 1000 * size * th * (a * a + b * b) ** 0.5
        step = (widths / 1000 * size + tc) * th
        if isinstance(step, float) and (not tw or font.wide or 32 not in raw):
            t, total = step, step * len(chars)
        else:
            spaces = 0.0 if not tw or font.wide else (np.frombuffer(raw, np.uint8) == 32) * (tw * th)
            ends = np.cumsum(np.full(len(chars), step) + spaces)
            t, total = np.append(0.0, ends[:-1]), float(ends[-1])
        out.append(Run(chars, rise * c + e, rise * d + f, a, b, t, advance, size * (c * c + d * d) ** 0.5, font.name))
        tm = _mul((1, 0, 0, 1, total, 0), tm)

    for op, a in _operators(p):
        try:
            if op == "Tm":
                tm = lm = tuple(a)
            elif op == "Tj":
                show(a[0])
            elif op == "q":
                stack.append(dict(state))
            elif op == "Q" and stack:
                state = stack.pop()
            elif op == "cm":
                state["ctm"] = _mul(a, state["ctm"])
            elif op == "BT":
                tm = lm = (1, 0, 0, 1, 0, 0)
            elif op == "Tf":
                state["font"], state["size"] = fonts.get(str(a[0])), float(a[1])
            elif op in ("Tc", "Tw", "TL", "Ts"):
                state[{"Tc": "tc", "Tw": "tw", "TL": "tl", "Ts": "rise"}[op]] = float(a[0])
            elif op == "Tz":
                state["th"] = a[0] / 100
            elif op in ("Td", "TD"):
                if op == "TD":
                    state["tl"] = -a[1]
                tm = lm = _mul((1, 0, 0, 1, a[0], a[1]), lm)
            elif op == "T*":
                tm = lm = _mul((1, 0, 0, 1, 0, -state["tl"]), lm)
            elif op in ("'", '"'):
                if op == '"':
                    state["tw"], state["tc"] = a[0], a[1]
                tm = lm = _mul((1, 0, 0, 1, 0, -state["tl"]), lm)
                show(a[-1])
            elif op == "TJ":
                for x in a[0]:
                    if isinstance(x, bytes):
                        show(x)
                    else:
                        tm = _mul((1, 0, 0, 1, -x / 1000 * state["size"] * state["th"], 0), tm)
            elif op == "re":
                path.append((a[0], a[1], a[0] + a[2], a[1] + a[3]))
            elif op in ("f", "F", "f*", "S", "s", "B", "B*", "b", "b*", "n"):
                if op != "n":
                    for r in path:
                        xs = [r[i] * state["ctm"][0] + r[j] * state["ctm"][2] + state["ctm"][4] for i in (0, 2) for j in (1, 3)]
                        ys = [r[i] * state["ctm"][1] + r[j] * state["ctm"][3] + state["ctm"][5] for i in (0, 2) for j in (1, 3)]
                        rects.append((min(xs), min(ys), max(xs), max(ys), {"f": "f", "F": "f", "f*": "f", "S": "s", "s": "s"}.get(op, "fs")))
                path = []
            elif op == "Do" and depth < 16:
                form = doc.get((doc.get(resources.get("XObject")) or {}).get(str(a[0])))
                if isinstance(form, Stream) and form.dict.get("Subtype") == "Form":
                    m = [float(doc.get(x)) for x in doc.get(form.dict.get("Matrix")) or (1, 0, 0, 1, 0, 0)]
                    inner = runs(doc, page, doc.decoded(form)[0], doc.get(form.dict.get("Resources")) or resources, _mul(m, state["ctm"]), depth + 1)
                    out += inner[0]
                    rects += inner[1]
            elif op == "ID":  # an inline image: its bytes end at EI between white space
                end = re.compile(rb"\sEI(?=\s|$)").search(content, p.at)
                p.at = end.end() if end else len(content)
        except (IndexError, TypeError, KeyError, ValueError) as e:
            doc.problems.append((p.at, "content", f"{op}: {e}"))
    return out, rects


def build(objects: dict[int, object], root: int, info: int | None = None, compress: bool = True, more: dict | None = None) -> bytes:
    """A whole file with a classic cross-reference table; ``more`` goes into the trailer."""
    out, places = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), {}
    for num in sorted(objects):
        value = objects[num]
        if isinstance(value, Stream) and compress and "Filter" not in value.dict and len(value.raw) > 64:
            value = Stream({**value.dict, "Filter": Name("FlateDecode")}, zlib.compress(value.raw))
        places[num] = len(out)
        out += b"%d 0 obj\n" % num + write(value) + b"\nendobj\n"
    start, size = len(out), max(objects) + 1
    out += b"xref\n0 %d\n0000000000 65535 f \n" % size
    for num in range(1, size):
        out += b"%010d 00000 n \n" % places[num] if num in places else b"0000000000 00000 f \n"
    trailer = {"Size": size, "Root": Ref(root)} | ({"Info": Ref(info)} if info else {}) | (more or {})
    return bytes(out + b"trailer\n" + write(trailer) + b"\nstartxref\n%d\n%%%%EOF\n" % start)


def append(data: bytes, changes: dict[int, object], prev: int, size: int, root: Ref) -> bytes:
    """An incremental update: the old bytes, the changed objects, and their table."""
    out = bytearray(data if data.endswith(b"\n") else data + b"\n")
    table = b""
    for num in sorted(changes):
        table += b"%d 1\n%010d 00000 n \n" % (num, len(out))
        out += b"%d 0 obj\n" % num + write(changes[num]) + b"\nendobj\n"
    start = len(out)
    return bytes(out + b"xref\n" + table + b"trailer\n" + write({"Size": max(size, max(changes) + 1), "Root": root, "Prev": prev}) + b"\nstartxref\n%d\n%%%%EOF\n" % start)


def from_pages(pages: list[list[tuple[float, float, str]]], title: str = "", size: float = 11.0, uris: dict[int, str] | None = None) -> bytes:
    """A document of Courier text: (x, baseline y, text) per page, y up."""
    objects: dict[int, object] = {1: {"Type": Name("Catalog"), "Pages": Ref(2), "Outlines": Ref(5)}, 3: {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Courier"), "Encoding": Name("WinAnsiEncoding")}, 4: {"Title": title.encode("latin-1") if title.isascii() else b"\xfe\xff" + title.encode("utf-16-be")}}
    kids, num = [], 6 + len(pages)
    for k, lines in enumerate(pages):
        body = b"BT /F1 %g Tf\n" % size + b"".join(b"1 0 0 1 %g %g Tm %s Tj\n" % (x, y, write(t.encode("cp1252", "replace"))) for x, y, t in lines) + b"ET"
        page = {"Type": Name("Page"), "Parent": Ref(2), "Contents": Ref(num + 1)}
        if uris and k in uris:
            page["Annots"] = [{"Type": Name("Annot"), "Subtype": Name("Link"), "Rect": [72, 700, 172, 712], "A": {"S": Name("URI"), "URI": uris[k].encode("latin-1", "replace")}}]
        objects[num], objects[num + 1] = page, Stream({}, body)
        objects[6 + k] = {"Title": b"Page %d" % (k + 1), "Parent": Ref(5), "Dest": [Ref(num), Name("Fit")]} | ({"Next": Ref(7 + k)} if k + 1 < len(pages) else {})
        kids.append(Ref(num))
        num += 2
    objects[5] = {"Type": Name("Outlines"), "Count": len(pages)} | ({"First": Ref(6)} if pages else {})
    objects[2] = {"Type": Name("Pages"), "Kids": kids, "Count": len(kids), "MediaBox": [0, 0, 612, 792], "Resources": {"Font": {"F1": Ref(3)}}}
    return build(objects, 1, 4)
