"""Samples of pixels: an array of bytes per image, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def colors(samples: Column, n: int) -> Column:
    """The pixels of interleaved samples as arrays of ``n`` values."""
    return F.transform(F.sequence(F.lit(0), (F.size(samples) / n).cast("int") - 1), lambda i: F.slice(samples, i * n + 1, F.lit(n)))


def color_count(pixels: Column) -> Column:
    return F.size(F.array_distinct(pixels))


def top_usage(pixels: Column) -> Column:
    """Share of the most frequent colour."""
    counts = F.transform(F.array_distinct(pixels), lambda c: F.size(F.filter(pixels, lambda p: p == c)))
    return F.array_max(counts) / F.size(pixels)


def is_monochrome(samples: Column) -> Column:
    return F.forall(samples, lambda v: (v == 0) | (v == 255))


def is_unicolor(pixels: Column) -> Column:
    return color_count(pixels) == 1


def invert(samples: Column) -> Column:
    return F.transform(samples, lambda v: 255 - v)


def gamma(samples: Column, g: float) -> Column:
    return F.transform(samples, lambda v: F.floor(F.pow(v / 255, F.lit(g)) * 255 + 0.5).cast("int"))


def tint(samples: Column, black: int, white: int) -> Column:
    """Grey values spread from one grey to another."""
    return F.transform(samples, lambda v: F.floor(black + v * (white - black) / 255 + 0.5).cast("int"))


def shrink(samples: Column, width: int, height: int) -> Column:
    """Half the size: whole means of 2 by 2 grey pixels."""
    w, h = width // 2, height // 2
    at = lambda i, dx, dy: F.element_at(samples, ((F.floor(i / w) * 2 + dy) * width + (i % w) * 2 + dx + 1).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(w * h - 1)), lambda i: F.floor((at(i, 0, 0) + at(i, 1, 0) + at(i, 0, 1) + at(i, 1, 1)) / 4).cast("int"))


def mae_similarity(a: Column, b: Column) -> Column:
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda s, x: s + x)
    return 1 - total / F.size(a) / 255


def ssim(a: Column, b: Column) -> Column:
    """Structural similarity over one window of all samples (constants of 8-bit samples)."""
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    product = lambda x, y: F.zip_with(x, y, lambda p, q: (p * q).cast("double"))
    ma, mb = mean(a), mean(b)
    va, vb, cov = mean(product(a, a)) - ma * ma, mean(product(b, b)) - mb * mb, mean(product(a, b)) - ma * mb
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return (2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))
