"""Editing one document: an overlay of changed objects, page operations, saving."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources import document as dc
from quire.sources.syntax import Name, Parser, Ref, Stream, write

APART = {"Page", "Pages", "Catalog", "Annot", "Widget", "ObjStm", "XRef"}


def text_string(text: str) -> bytes:
    return text.encode("ascii") if text.isascii() else b"\xfe\xff" + text.encode("utf-16-be")


def references(value) -> Iterator[Ref]:
    if isinstance(value, Ref):
        yield value
    inner = value.dict.values() if isinstance(value, Stream) else value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    for v in inner:
        yield from references(v)


def remapped(value, to: dict[int, int]):
    """A value with its references renamed; those to nothing become null."""
    if isinstance(value, Ref):
        return Ref(to[value.num]) if value.num in to else None
    if isinstance(value, Stream):
        return Stream(remapped(value.dict, to), value.raw)
    if isinstance(value, dict):
        return {k: remapped(v, to) for k, v in value.items()}
    return [remapped(v, to) for v in value] if isinstance(value, list) else value


class Editor:
    def __init__(self, data: bytes, password: bytes = b""):
        self.doc = dc.Document(data, password=password)
        self.changes: dict[int, object] = {}
        self.tainted = self.doc.repaired

    # objects
    def get(self, value):
        while isinstance(value, Ref):
            value = self.changes[value.num] if value.num in self.changes else self.doc.get(Ref(value.num))
        return value

    def numbers(self) -> list[int]:
        return sorted(n for n in {*self.doc.entries, *self.changes} if n and self.get(Ref(n)) is not None)

    def add(self, value) -> Ref:
        num = max([0, *self.doc.entries, *self.changes]) + 1
        self.changes[num] = value
        return Ref(num)

    def update(self, ref: Ref, value) -> None:
        self.changes[ref.num] = value

    def delete(self, ref: Ref) -> None:
        self.changes[ref.num] = None

    def get_key(self, num: int, key: str) -> str | None:
        v = self.get(Ref(num))
        v = (v.dict if isinstance(v, Stream) else v).get(key)
        return None if v is None else write(v).decode("latin-1")

    def set_key(self, num: int, key: str, value: str) -> None:
        """``value`` is an object's syntax; ``null`` takes the key away."""
        old, new = self.get(Ref(num)), Parser(value.encode()).object()
        entries = {k: v for k, v in (old.dict if isinstance(old, Stream) else old).items() if k != key} | ({} if new is None else {key: new})
        self.update(Ref(num), Stream(entries, old.raw) if isinstance(old, Stream) else entries)

    # catalog
    @property
    def root(self) -> Ref:
        return self.doc.trailer["Root"]

    def _catalog(self, **entries) -> None:
        self.update(self.root, {k: v for k, v in {**self.get(self.root), **entries}.items() if v is not None})

    def set_metadata(self, **info: str) -> None:
        ref = self.doc.trailer.get("Info")
        new = {**(self.get(ref) or {}), **{k: text_string(v) for k, v in info.items()}}
        if isinstance(ref, Ref):
            self.update(ref, new)
        else:
            self.doc.trailer["Info"] = self.add(new)

    def set_language(self, tag: str) -> None:
        self._catalog(Lang=text_string(tag))

    def set_layout(self, layout: str, mode: str = "UseNone") -> None:
        self._catalog(PageLayout=Name(layout), PageMode=Name(mode))

    def set_labels(self, rules: list[tuple[int, str, str, int]]) -> None:
        """(start page, prefix, style, first number)"""
        nums = [x for start, prefix, style, first in sorted(rules) for x in (start, {k: v for k, v in {"P": text_string(prefix) or None, "S": Name(style) if style else None, "St": first}.items() if v is not None})]
        self._catalog(PageLabels={"Nums": nums})

    def set_toc(self, entries: list[tuple[int, str, int]]) -> None:
        """(level, title, page index); a level is at most one deeper than the one before."""
        pages, refs = self.pages(), [self.add({}) for _ in entries]
        top = self.add({})
        parents, last, kids = [top], {}, {}
        for (level, title, page), ref in zip(entries, refs, strict=True):
            if not 1 <= level <= len(parents):
                raise ValueError("a level is skipped")
            parents = [*parents[:level], ref]
            parent = parents[level - 1]
            item = {"Title": text_string(title), "Parent": parent} | ({"Dest": [pages[page], Name("Fit")]} if 0 <= page < len(pages) else {})
            if parent in last:
                item["Prev"] = last[parent]
                self.changes[last[parent].num]["Next"] = ref
            last[parent] = ref
            kids.setdefault(parent, []).append(ref)
            self.update(ref, item)
        for parent, members in kids.items():
            self.changes[parent.num] |= {"First": members[0], "Last": members[-1], "Count": len(members)}
        self._catalog(Outlines=top if entries else None)

    def embed(self, name: str, content: bytes, description: str = "") -> None:
        names = dict(self.get(self.get(self.root).get("Names")) or {})
        tree = list(self.get((self.get(names.get("EmbeddedFiles")) or {}).get("Names")) or [])
        spec = {"Type": Name("Filespec"), "F": text_string(name), "UF": text_string(name), "Desc": text_string(description), "EF": {"F": self.add(Stream({"Type": Name("EmbeddedFile"), "Params": {"Size": len(content)}}, content))}}
        pairs = sorted([*zip(tree[::2], tree[1::2], strict=True), (text_string(name), self.add(spec))], key=lambda p: p[0])
        names["EmbeddedFiles"] = {"Names": [x for p in pairs for x in p]}
        self._catalog(Names=names)

    # pages
    def pages(self) -> list[Ref]:
        out, todo = [], [self.get(self.root)["Pages"]]
        while todo:
            ref = todo.pop()
            node = self.get(ref)
            if isinstance(node, dict) and "Kids" in node:
                todo += reversed(self.get(node["Kids"]))
            elif isinstance(node, dict):
                out.append(ref)
        return out

    def arrange(self, refs: list[Ref]) -> None:
        """A flat page tree of these pages, with what they inherited; a page that comes
        again is a copy."""
        have = {num: page for num, page in self.doc.pages()}
        top, kids, seen = self.get(self.root)["Pages"], [], set()
        for ref in refs:
            page = {**{k: v for k, v in have.get(ref.num, {}).items() if k in dc.INHERITED}, **self.get(ref), "Parent": top}
            if ref.num in seen:
                ref = self.add(page)
            else:
                self.update(ref, page)
            seen.add(ref.num)
            kids.append(ref)
        self.update(top, {"Type": Name("Pages"), "Kids": kids, "Count": len(kids)})

    def select(self, indices: list[int]) -> None:
        pages = self.pages()
        self.arrange([pages[i] for i in indices])

    def delete_pages(self, indices: list[int]) -> None:
        self.arrange([p for i, p in enumerate(self.pages()) if i not in set(indices)])

    def new_page(self, at: int, width: float = 612, height: float = 792) -> Ref:
        ref = self.add({"Type": Name("Page"), "MediaBox": [0, 0, width, height], "Resources": {}})
        pages = self.pages()
        self.arrange([*pages[:at], ref, *pages[at:]])
        return ref

    def rotate(self, index: int, degrees: int) -> None:
        if degrees % 90:
            raise ValueError("a page turns by quarters")
        ref = self.pages()[index]
        self.update(ref, {**self.get(ref), "Rotate": degrees % 360})

    def set_box(self, index: int, box: list[float], kind: str = "CropBox") -> None:
        ref = self.pages()[index]
        self.update(ref, {**self.get(ref), kind: box})

    def annotate(self, index: int, kind: str, rect: list[float], contents: str = "", uri: str | None = None) -> Ref:
        page = self.pages()[index]
        entry = {"Type": Name("Annot"), "Subtype": Name(kind), "Rect": rect, "P": page} | ({"Contents": text_string(contents)} if contents else {}) | ({"A": {"S": Name("URI"), "URI": uri.encode()}} if uri else {})
        ref = self.add(entry)
        p = self.get(page)
        self.update(page, {**p, "Annots": [*(self.get(p.get("Annots")) or []), ref]})
        return ref

    def insert_text(self, index: int, x: float, y: float, text: str, size: float = 11) -> None:
        page = self.pages()[index]
        p = dict(self.get(page))
        inherited = next((q for n, q in self.doc.pages() if n == page.num), {})
        res = dict(self.get(p.get("Resources", inherited.get("Resources"))) or {})
        res["Font"] = {**(self.get(res.get("Font")) or {}), "Ftext": self.add({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Courier"), "Encoding": Name("WinAnsiEncoding")})}
        body = self.add(Stream({}, b"q BT /Ftext %g Tf %g %g Td %s Tj ET Q" % (size, x, y, write(text.encode("cp1252", "replace")))))
        old = p.get("Contents")
        p |= {"Resources": res, "Contents": [*(self.get(old) if isinstance(self.get(old), list) else [old] if old else []), body]}
        self.update(page, p)

    def redact(self, index: int, box: list[float]) -> int:
        """Takes every shown string with a glyph that meets the box out of the page's
        content, and returns how many glyphs met it.  The document can't be saved
        incrementally after that, as its old bytes would keep them."""
        page = self.pages()[index]
        p = next((q for n, q in self.doc.pages() if n == page.num), self.get(page))
        meets = lambda g: g.x < box[2] and g.x + g.advance > box[0] and g.y - 0.25 * g.size < box[3] and g.y + 0.75 * g.size > box[1]
        glyphs, _ = dc.interpret(self.doc, p)
        hit = [g for g in glyphs if meets(g)]
        if hit:
            left = [g for g in glyphs if not meets(g)]
            fonts = self.get((self.get(p.get("Resources")) or {}).get("Font")) or {}
            body = b"BT\n" + b"".join(b"/%s %g Tf 1 0 0 1 %g %g Tm %s Tj\n" % (next(iter(fonts), "F1").encode(), g.size, g.x, g.y, write(g.unicode.encode("cp1252", "replace"))) for g in left) + b"ET"
            for old in [o] if isinstance(o := p.get("Contents"), Ref) else self.get(o) or []:
                if isinstance(old, Ref):
                    self.delete(old)
            self.update(page, {**self.get(page), "Contents": self.add(Stream({}, body))})
            self.tainted = True
        return len(hit)

    def append_pages(self, other: Editor) -> None:
        """All pages of another document after the own ones, with all they refer to."""
        first = max([0, *self.doc.entries, *self.changes]) + 1
        todo, to = list(other.pages()), {}
        inherited = dict(other.doc.pages())
        tops = {r.num for r in todo}
        while todo:
            ref = todo.pop()
            if ref.num in to or other.get(ref) is None:
                continue
            to[ref.num] = first + len(to)
            value = other.get(ref)
            if ref.num in tops:
                value = {k: v for k, v in {**{k: v for k, v in inherited.get(ref.num, {}).items() if k in dc.INHERITED}, **value}.items() if k != "Parent"}
            self.changes[to[ref.num]] = (ref.num, value)
            todo += references(value)
        for num in to.values():
            self.changes[num] = remapped(self.changes[num][1], to)
        self.arrange([*self.pages(), *(Ref(to[r.num]) for r in other.pages())])

    # saving
    def can_save_incrementally(self) -> bool:
        return not self.tainted and self.doc.handler is None

    def save_incremental(self) -> bytes:
        if not self.can_save_incrementally():
            raise ValueError("this document must be saved whole")
        at = self.doc.data.rfind(b"startxref")
        prev = Parser(self.doc.data, at + 9).object()
        return dc.append(self.doc.data, {n: v for n, v in self.changes.items()}, prev, max([0, *self.doc.entries, *self.changes]) + 1, self.root)

    def save(self, garbage: int = 0, compress: bool = True) -> bytes:
        objects = {n: self.get(Ref(n)) for n in self.numbers()}
        objects = {n: v for n, v in objects.items() if not (isinstance(v, Stream) and v.dict.get("Type") in ("XRef", "ObjStm"))}
        root, info = self.root, self.doc.trailer.get("Info")
        if garbage >= 1:
            todo, live = [r for r in (root, info) if isinstance(r, Ref)], set()
            while todo:
                r = todo.pop()
                if r.num not in live and r.num in objects:
                    live.add(r.num)
                    todo += references(objects[r.num])
            objects = {n: v for n, v in objects.items() if n in live}
        to = {n: n for n in objects}
        if garbage >= 3:  # one pass: signatures are those of before any merge
            first: dict[bytes, int] = {}
            for n, v in objects.items():
                inner = v.dict if isinstance(v, Stream) else v
                if isinstance(inner, dict) and (inner.get("Type") in APART or "StructParent" in inner or "StructParents" in inner) or isinstance(v, Stream) and garbage < 4:
                    continue
                to[n] = first.setdefault(write(v), n)
        kept = [n for n in objects if to[n] == n]
        if garbage >= 2:
            new = {n: k for k, n in enumerate(kept, 1)}
            to = {n: new[m] for n, m in to.items()}
        out = {to[n]: remapped(objects[n], to) for n in kept}
        return dc.build(out, to[root.num], to.get(info.num) if isinstance(info, Ref) else None, compress)


def saved(files: DataFrame, garbage: int = 4, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """(doc_id, content): every document saved whole; null where it can't be read."""

    @F.pandas_udf("binary")
    def run(contents: pd.Series) -> pd.Series:
        out = []
        for c in contents:
            try:
                out.append(Editor(bytes(c)).save(garbage))
            except Exception:
                out.append(None)
        return pd.Series(out, dtype=object)

    return files.select(id_col, run(content_col).alias(content_col))
