"""What a document holds besides its text: fonts, images, forms, annotations, fields,
attachments, layers, named destinations and label rules, as rows."""

from __future__ import annotations

from quire.sources.document import Document
from quire.sources.syntax import Ref, Stream, text_of


def _num(ref) -> int:
    return ref.num if isinstance(ref, Ref) else 0


def _text(doc: Document, value) -> str | None:
    value = doc.get(value)
    return text_of(value) if isinstance(value, bytes) else None if value is None else str(value)


def _rect(doc: Document, value) -> list[float | None]:
    value = doc.get(value)
    return [float(doc.get(x)) for x in value] if isinstance(value, list) and len(value) == 4 else [None] * 4


def _resources(doc: Document, page: dict, kind: str):
    """(name, reference, object) of one kind in a page's resources and those of its forms."""
    todo, seen = [page.get("Resources")], set()
    while todo:
        res = doc.get(todo.pop())
        if not isinstance(res, dict):
            continue
        for name, ref in sorted((doc.get(res.get(kind)) or {}).items()):
            yield name, ref, doc.get(ref)
        for ref in (doc.get(res.get("XObject")) or {}).values():
            form = doc.get(ref)
            if _num(ref) not in seen and isinstance(form, Stream) and form.dict.get("Subtype") == "Form":
                seen.add(_num(ref))
                todo.append(form.dict.get("Resources"))


def _pages(doc: Document):
    return enumerate(p for _, p in doc.pages())


def tree(doc: Document, root, leaf: str):
    """Pairs of a name tree (leaf ``Names``) or number tree (leaf ``Nums``), in order."""
    todo, seen = [root], set()
    while todo:
        ref = todo.pop()
        node = doc.get(ref)
        if not isinstance(node, dict) or (_num(ref) and _num(ref) in seen):
            continue
        seen.add(_num(ref))
        pairs = doc.get(node.get(leaf)) or []
        yield from zip((doc.get(k) for k in pairs[::2]), pairs[1::2], strict=False)
        todo += reversed(doc.get(node.get("Kids")) or [])


def _root(doc: Document) -> dict:
    root = doc.get(doc.trailer.get("Root"))
    return root if isinstance(root, dict) else {}


def fonts(i, doc):
    for k, page in _pages(doc):
        for name, ref, f in _resources(doc, page, "Font"):
            if isinstance(f, dict):
                enc = doc.get(f.get("Encoding"))
                yield i, k, _num(ref), str(f.get("Subtype", "")), str(doc.get(f.get("BaseFont")) or ""), name, str(enc.get("BaseEncoding", "") if isinstance(enc, dict) else enc or "")


def images(i, doc):
    for k, page in _pages(doc):
        for name, ref, x in _resources(doc, page, "XObject"):
            if isinstance(x, Stream) and x.dict.get("Subtype") == "Image":
                space, filt = doc.get(x.dict.get("ColorSpace")), doc.get(x.dict.get("Filter"))
                first = lambda v: str(doc.get(v[0]) if isinstance(v, list) and v else v or "")
                yield i, k, _num(ref), name, int(doc.get(x.dict.get("Width")) or 0), int(doc.get(x.dict.get("Height")) or 0), int(doc.get(x.dict.get("BitsPerComponent")) or 0), first(space), first(filt), _num(x.dict.get("SMask"))


def xobjects(i, doc):
    for k, page in _pages(doc):
        for name, ref, x in _resources(doc, page, "XObject"):
            if isinstance(x, Stream):
                yield i, k, _num(ref), name, str(x.dict.get("Subtype", "")), *_rect(doc, x.dict.get("BBox"))


def annots(i, doc):
    for k, page in _pages(doc):
        for ref in doc.get(page.get("Annots")) or []:
            a = doc.get(ref)
            if isinstance(a, dict):
                yield i, k, _num(ref), str(a.get("Subtype", "")), _text(doc, a.get("NM")), _text(doc, a.get("Contents")), *_rect(doc, a.get("Rect"))


def fields(i, doc):
    """Terminal fields of the form with their full names and inherited types and values."""
    form = doc.get(_root(doc).get("AcroForm"))
    todo = [(f, "", {}) for f in reversed(doc.get(form.get("Fields")) or [])] if isinstance(form, dict) else []
    seen = set()
    while todo:
        ref, above, have = todo.pop()
        f = doc.get(ref)
        if not isinstance(f, dict) or (_num(ref) and _num(ref) in seen):
            continue
        seen.add(_num(ref))
        part = _text(doc, f.get("T"))
        name = f"{above}.{part}" if above and part else part or above
        have = have | {n: f[n] for n in ("FT", "V", "Ff") if n in f}
        kids = [x for x in doc.get(f.get("Kids")) or [] if isinstance(doc.get(x), dict) and "T" in doc.get(x)]
        if kids:
            todo += [(x, name, have) for x in reversed(kids)]
        else:
            yield i, _num(ref), name, str(doc.get(have.get("FT")) or ""), _text(doc, have.get("V")), int(doc.get(have.get("Ff")) or 0)


def attachments(i, doc):
    names = doc.get(_root(doc).get("Names")) or {}
    for name, ref in tree(doc, names.get("EmbeddedFiles"), "Names"):
        spec = doc.get(ref) or {}
        stream = doc.get((doc.get(spec.get("EF")) or {}).get("F"))
        if isinstance(stream, Stream):
            yield i, text_of(name), _text(doc, spec.get("UF") or spec.get("F")), _text(doc, spec.get("Desc")), len(stream.raw), doc.decoded(stream)[0]


def layers(i, doc):
    oc = doc.get(_root(doc).get("OCProperties"))
    if isinstance(oc, dict):
        d = doc.get(oc.get("D")) or {}
        off = {_num(r) for r in doc.get(d.get("OFF")) or []}
        on = {_num(r) for r in doc.get(d.get("ON")) or []}
        locked = {_num(r) for r in doc.get(d.get("Locked")) or []}
        base_off = d.get("BaseState") == "OFF"
        for ref in doc.get(oc.get("OCGs")) or []:
            g = doc.get(ref) or {}
            yield i, _num(ref), _text(doc, g.get("Name")), (_num(ref) in on) if base_off else (_num(ref) not in off), _num(ref) in locked


def destinations(i, doc):
    index = {num: k for k, (num, _) in enumerate(doc.pages())}
    old = doc.get(_root(doc).get("Dests")) or {}
    names = doc.get(_root(doc).get("Names")) or {}
    for name, dest in [*((k.encode(), v) for k, v in sorted(old.items())), *tree(doc, names.get("Dests"), "Names")]:
        dest = doc.get(dest)
        dest = doc.get(dest.get("D")) if isinstance(dest, dict) else dest
        if isinstance(dest, list) and dest:
            number = lambda n: float(dest[n]) if len(dest) > n and isinstance(dest[n], int | float) else None  # noqa: E731, B023
            yield i, text_of(name), index.get(_num(dest[0]), -1), number(2), number(3)


def label_rules(i, doc):
    for start, rule in tree(doc, _root(doc).get("PageLabels"), "Nums"):
        rule = doc.get(rule) or {}
        yield i, int(start), _text(doc, rule.get("P")) or "", str(rule.get("S", "")), int(doc.get(rule.get("St")) or 1)


RELATIONS = {
    "fonts": (fonts, "doc_id long, page_no int, num int, type string, basefont string, name string, encoding string"),
    "images": (images, "doc_id long, page_no int, num int, name string, width int, height int, bpc int, colorspace string, filter string, smask int"),
    "xobjects": (xobjects, "doc_id long, page_no int, num int, name string, type string, x0 double, y0 double, x1 double, y1 double"),
    "annots": (annots, "doc_id long, page_no int, num int, type string, name string, contents string, x0 double, y0 double, x1 double, y1 double"),
    "fields": (fields, "doc_id long, num int, name string, type string, value string, flags int"),
    "attachments": (attachments, "doc_id long, name string, filename string, description string, stored_bytes int, content binary"),
    "layers": (layers, "doc_id long, num int, name string, is_on boolean, locked boolean"),
    "destinations": (destinations, "doc_id long, name string, page int, x double, y double"),
    "label_rules": (label_rules, "doc_id long, startpage int, prefix string, style string, firstpagenum int"),
}
