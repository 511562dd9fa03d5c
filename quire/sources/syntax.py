"""Objects of the page-document format (ISO 32000): reading and writing their syntax.

Python values stand for objects: None, bool, int, float, ``Name``, bytes for strings, list,
dict, ``Ref`` and ``Stream``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache


class Name(str):
    __slots__ = ()


@dataclass(frozen=True, order=True)
class Ref:
    num: int
    gen: int = 0


@dataclass
class Stream:
    dict: dict
    raw: bytes = field(repr=False)


class Keyword(str):
    """A bare word: an operator of a content stream, or obj, R and the like."""

    __slots__ = ()


class SyntaxProblem(ValueError):
    pass


WHITE, DELIMITERS = b"\0\t\n\f\r ", b"()<>[]{}/%"
_REGULAR = re.compile(rb"[^\0\t\n\f\r ()<>\[\]{}/%]+")
_SKIP = re.compile(rb"(?:[\0\t\n\f\r ]+|%[^\r\n]*)*")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)$")
_REF = re.compile(rb"[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+R(?![^\0\t\n\f\r ()<>\[\]{}/%])")
_KEY = re.compile(rb"[\0\t\n\f\r ]*/([^\0\t\n\f\r ()<>\[\]{}/%#]*+)(?!#)")
_ENDSTREAM = re.compile(rb"\s*endstream")
_PLAIN, _OCTAL = re.compile(rb"[^()\\]*"), re.compile(rb"[0-7]{1,3}")
_PRINTED, _SPECIAL, _UNNAMED = re.compile(rb"[ -~]*"), re.compile(rb"[\\()]"), re.compile(rb"[^!-~]|[#()<>\[\]{}/%]")
_WORDS = {b"true": True, b"false": False, b"null": None}
_ESCAPES = {ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("b"): 8, ord("f"): 12}
MAX_DEPTH = 256


class Parser:
    """Recursive descent over bytes from ``at``."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        self.at = _SKIP.match(self.data, self.at).end()

    def object(self, depth: int = 0, refs: bool = True):
        """The next object or keyword; raises at the end of the data."""
        if depth > MAX_DEPTH:
            raise SyntaxProblem("nested too deep")
        data = self.data
        self.at = at = _SKIP.match(data, self.at).end()
        if at >= len(data):
            raise SyntaxProblem("unexpected end")
        c = data[at]
        if c == 0x2F:
            m = _REGULAR.match(data, at + 1)
            raw = m[0] if m else b""
            self.at = at + 1 + len(raw)
            return Name((re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), raw) if b"#" in raw else raw).decode("utf-8", "replace"))
        if c == 0x28:
            return self._literal()
        if data.startswith(b"<<", at):
            self.at += 2
            out: dict = {}
            while True:
                if m := _KEY.match(data, self.at):
                    self.at = m.end()
                    out[m[1].decode("utf-8", "replace")] = self.object(depth + 1)
                    continue
                self.skip()
                if self.data.startswith(b">>", self.at):
                    self.at += 2
                    return out
                key = self.object(depth + 1)
                if not isinstance(key, Name):
                    raise SyntaxProblem("a key is not a name")
                out[str(key)] = self.object(depth + 1)
        if c == 0x3C:
            end = data.find(b">", at)
            if end < 0:
                raise SyntaxProblem("unclosed string")
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at + 1 : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == 0x5B:
            self.at += 1
            items: list = []
            while True:
                self.skip()
                if self.data[self.at : self.at + 1] == b"]":
                    self.at += 1
                    return items
                items.append(self.object(depth + 1, refs))
        m = _REGULAR.match(data, at)
        if not m:
            self.at += 1
            return Keyword(chr(c))
        self.at = m.end()
        word = m[0]
        if _NUMBER.match(word):
            if refs and word.isdigit():
                r = _REF.match(data, self.at)
                if r:
                    self.at = r.end()
                    return Ref(int(word), int(r[1]))
            return float(word) if b"." in word else int(word)
        return _WORDS[word] if word in _WORDS else Keyword(word.decode("latin-1"))

    def _literal(self) -> bytes:
        out, depth, i, data = bytearray(), 1, self.at + 1, self.data
        while i < len(data):
            plain = _PLAIN.match(data, i)
            out += plain[0]
            i = plain.end()
            if i >= len(data):
                break
            c = data[i]
            if c == 0x5C:
                i += 1
                c = data[i] if i < len(data) else 0
                if 0x30 <= c <= 0x37:
                    m = _OCTAL.match(data, i)
                    out.append(int(m[0], 8) & 255)
                    i = m.end()
                    continue
                if c == 13:
                    i += 2 if data[i + 1 : i + 2] == b"\n" else 1
                    continue
                if c != 10:
                    out.append(_ESCAPES.get(c, c))
                i += 1
                continue
            depth += 1 if c == 0x28 else -1
            i += 1
            if not depth:
                self.at = i
                return bytes(out)
            out.append(c)
        raise SyntaxProblem("unclosed string")

    def indirect(self, length=lambda v: v if isinstance(v, int) else None) -> tuple[Ref, object]:
        """``N G obj ... endobj``; ``length`` resolves a stream's length.  A wrong length is
        mended by the place of ``endstream``."""
        num, gen, word = self.object(refs=False), self.object(refs=False), self.object()
        if not (isinstance(num, int) and isinstance(gen, int) and word == "obj"):
            raise SyntaxProblem("not an object")
        value = self.object()
        self.skip()
        if isinstance(value, dict) and self.data.startswith(b"stream", self.at):
            at = self.at + 6
            at += 2 if self.data[at : at + 2] == b"\r\n" else 1 if self.data[at : at + 1] in (b"\n", b"\r") else 0
            n = length(value.get("Length"))
            if n is None or n < 0 or not _ENDSTREAM.match(self.data, at + n):
                end = self.data.find(b"endstream", at)
                end = len(self.data) if end < 0 else end
                n = len(self.data[at:end].removesuffix(b"\n").removesuffix(b"\r"))
            self.at = at + n
            value = Stream(value, self.data[at : at + n])
        return Ref(num, gen), value


@lru_cache(maxsize=4096)
def _name(value: str) -> bytes:
    return b"/" + _UNNAMED.sub(lambda m: b"#%02X" % m[0][0], value.encode())


def write(value) -> bytes:
    """Canonical text of an object; dictionaries in the order of their keys."""
    if isinstance(value, bytes):
        if _PRINTED.fullmatch(value):
            return b"(" + (_SPECIAL.sub(rb"\\\g<0>", value) if _SPECIAL.search(value) else value) + b")"
        return b"<" + value.hex().upper().encode() + b">"
    if type(value) is int:
        return b"%d" % value
    if value is None:
        return b"null"
    if isinstance(value, bool):
        return b"true" if value else b"false"
    if isinstance(value, Name):
        return _name(str(value))
    if isinstance(value, int):
        return b"%d" % value
    if isinstance(value, float):
        return f"{value:.6f}".rstrip("0").rstrip(".").encode() or b"0"
    if isinstance(value, Ref):
        return b"%d %d R" % (value.num, value.gen)
    if isinstance(value, list):
        return b"[" + b" ".join(map(write, value)) + b"]"
    if isinstance(value, Stream):
        return write({**value.dict, "Length": len(value.raw)}) + b"\nstream\n" + value.raw + b"\nendstream"
    return b"<<" + b"".join([_name(k) + b" " + write(v) for k, v in sorted(value.items())]) + b">>"


def text_of(raw: bytes) -> str:
    """A text string: UTF-16BE or UTF-8 by its mark, else single bytes."""
    if raw.startswith(b"\xfe\xff"):
        return raw[2:].decode("utf-16-be", "replace")
    if raw.startswith(b"\xef\xbb\xbf"):
        return raw[3:].decode("utf-8", "replace")
    return raw.decode("latin-1")
