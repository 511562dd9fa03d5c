"""String, numbering and colour functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,m:string>>"


def tokens(text: Column) -> Column:
    """array<struct(start int, end int, m string)>: what stands between spaces, with
    code-point offsets.  One pass over the pieces; no explode and no shuffle."""
    pieces = F.split(text, "(?<= )(?! )|(?<! )(?= )", -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc, p):
        end = acc["at"] + F.char_length(p)
        kept = F.when((p == "") | F.startswith(p, F.lit(" ")), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), end.alias("end"), p.alias("m")))))
        return F.struct(end.alias("at"), kept.alias("out"))

    return F.aggregate(pieces, start, step, lambda a: a["out"])


def dehyphenate(text: Column) -> Column:
    return F.regexp_replace(text, "-\n", "")


def html_escape(text: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(name))
    return text


def json_number(v: Column) -> Column:
    """Integers bare, else up to six decimals without trailing zeros; 0 if not finite."""
    finite = ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    trimmed = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", v), "0+$", ""), r"\.$", "")
    return F.when(~finite, "0").when(v == F.floor(v), F.format_string("%.0f", v)).otherwise(trimmed)


def roman(n: Column, upper: bool = True) -> Column:
    """Roman numerals of positive numbers; empty for others."""
    digits = ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")
    at = lambda k, one, five, ten: F.element_at(F.array(*(F.lit(d.translate(str.maketrans("IVX", one + five + ten))) for d in digits)), (F.floor(n / k) % 10).cast("int") + 1)
    text = F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), at(100, "C", "D", "M"), at(10, "X", "L", "C"), at(1, "I", "V", "X"))
    text = F.when(n > 0, text).otherwise("")
    return text if upper else F.lower(text)


def alpha(n: Column, upper: bool = True) -> Column:
    """a to z, then aa to zz and so on, of positive numbers."""
    letter = F.char(((n - 1) % 26 + 97).cast("int"))
    text = F.when(n > 0, F.repeat(letter, (F.floor((n - 1) / 26) + 1).cast("int"))).otherwise("")
    return F.upper(text) if upper else text


def page_label(n: Column, style: Column, prefix: Column) -> Column:
    """Prefix and number in style D, R, r, A or a; the prefix alone for any other."""
    number = F.when(style == "D", n.cast("string")).when(style == "R", roman(n)).when(style == "r", roman(n, False)).when(style == "A", alpha(n)).when(style == "a", alpha(n, False)).otherwise("")
    return F.concat(prefix, number)


def pdf_string(text: Column) -> Column:
    """A literal string for ASCII, else hexadecimal UTF-16BE with a byte-order mark."""
    plain = F.concat(F.lit("("), F.regexp_replace(text, r"([\\()])", r"\\$1"), F.lit(")"))
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), plain).otherwise(F.concat(F.lit("<FEFF"), F.hex(F.encode(text, "UTF-16BE")), F.lit(">")))


def pdf_date(ts: Column) -> Column:
    return F.concat(F.lit("D:"), F.date_format(ts, "yyyyMMddHHmmss"), F.lit("+00'00'"))


def strip_subset_tag(name: Column) -> Column:
    return F.regexp_replace(name, r"^[A-Z]{6}\+", "")


def style_flags(name: Column) -> Column:
    """Bits of a font name: italic 2, serif 4, fixed width 8, bold 16."""
    low = F.lower(name)
    any_of = lambda *w: low.rlike("|".join(w))
    bit = lambda on, v: F.when(on, F.lit(v)).otherwise(F.lit(0))
    serif = any_of("times", "georgia", "roman", "minion", "garamond") | (any_of("serif") & ~any_of("sans"))
    return bit(any_of("italic", "oblique"), 2) + bit(serif, 4) + bit(any_of("mono", "courier", "consol"), 8) + bit(any_of("bold", "black", "heavy"), 16)


def language(tag: Column) -> Column:
    """A language tag with its parts in the usual case; null unless well formed."""
    clean = F.replace(F.trim(tag), F.lit("_"), F.lit("-"))
    parts = F.split(clean, "-")
    cased = F.transform(parts, lambda p, i: F.when(i == 0, F.lower(p)).when(F.char_length(p) == 2, F.upper(p)).when(F.char_length(p) == 4, F.initcap(p)).otherwise(F.lower(p)))
    return F.when(clean.rlike("^[A-Za-z]{2,3}(-[A-Za-z0-9]{1,8})*$"), F.array_join(cased, "-"))


def _byte(v: Column) -> Column:
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * 255 + 0.5).cast("int")


def packed_rgb(r: Column, g: Column, b: Column) -> Column:
    """0xRRGGBB of parts from 0 to 1."""
    return _byte(r) * 65536 + _byte(g) * 256 + _byte(b)


def cmyk_rgb(c: Column, m: Column, y: Column, k: Column) -> Column:
    return packed_rgb((1 - c) * (1 - k), (1 - m) * (1 - k), (1 - y) * (1 - k))


def rgb_parts(packed: Column) -> tuple[Column, Column, Column]:
    return F.shiftright(packed, 16).bitwiseAND(255), F.shiftright(packed, 8).bitwiseAND(255), packed.bitwiseAND(255)
