"""Points, rectangles and matrices as Column expressions.

A rectangle is four columns (x0, y0, x1, y1) in a ``Rect``, a matrix six in a ``Matrix``;
nothing is boxed in structs until it is asked for, so all of it stays in generated code.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points per unit of length.
UNITS = {"px": 1.0, "in": 72.0, "cm": 72.0 / 2.54, "mm": 72.0 / 25.4}
#: Named paper sizes in points.
PAPER = {"a3": (842, 1191), "a4": (595, 842), "a5": (420, 595), "a6": (298, 420), "b4": (709, 1001), "b5": (499, 709), "legal": (612, 1008), "letter": (612, 792), "ledger": (792, 1224), "tabloid": (792, 1224)}

#: The corners of the rectangle that holds everything.
INFINITE = (-2147483648.0, 2147483520.0)


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


@dataclass(frozen=True)
class Rect:
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @staticmethod
    def of(x0, y0, x1, y1) -> Rect:
        return Rect(_col(x0), _col(y0), _col(x1), _col(y1))

    @staticmethod
    def named(prefix: str = "") -> Rect:
        return Rect(*(F.col(prefix + c) for c in ("x0", "y0", "x1", "y1")))

    def columns(self, prefix: str = "") -> list[Column]:
        return [c.alias(prefix + n) for c, n in zip((self.x0, self.y0, self.x1, self.y1), ("x0", "y0", "x1", "y1"), strict=True)]

    def width(self, unit: str = "px") -> Column:
        return F.greatest(self.x1 - self.x0, F.lit(0.0)) / UNITS[unit]

    def height(self, unit: str = "px") -> Column:
        return F.greatest(self.y1 - self.y0, F.lit(0.0)) / UNITS[unit]

    def area(self, unit: str = "px") -> Column:
        return self.width(unit) * self.height(unit)

    def is_empty(self) -> Column:
        return (self.x0 >= self.x1) | (self.y0 >= self.y1)

    def is_valid(self) -> Column:
        return (self.x0 <= self.x1) & (self.y0 <= self.y1)

    def is_infinite(self) -> Column:
        low, high = INFINITE
        return (self.x0 == low) & (self.y0 == low) & (self.x1 == high) & (self.y1 == high)

    def normalize(self) -> Rect:
        return Rect(F.least(self.x0, self.x1), F.least(self.y0, self.y1), F.greatest(self.x0, self.x1), F.greatest(self.y0, self.y1))

    def _either(self, other: Rect, fn) -> Rect:
        """An empty operand is skipped: the other one is the result."""
        pick = lambda a, b, both: F.when(self.is_empty(), b).when(other.is_empty(), a).otherwise(both)
        return Rect(*(pick(a, b, f(a, b)) for a, b, f in zip((self.x0, self.y0, self.x1, self.y1), (other.x0, other.y0, other.x1, other.y1), fn, strict=True)))

    def union(self, other: Rect) -> Rect:
        return self._either(other, (F.least, F.least, F.greatest, F.greatest))

    def intersect(self, other: Rect) -> Rect:
        """Largest rectangle in both; all zeros where they don't overlap."""
        x0, y0, x1, y1 = F.greatest(self.x0, other.x0), F.greatest(self.y0, other.y0), F.least(self.x1, other.x1), F.least(self.y1, other.y1)
        apart = (x0 >= x1) | (y0 >= y1)
        return Rect(*(F.when(apart, F.lit(0.0)).otherwise(c) for c in (x0, y0, x1, y1)))

    def intersects(self, other: Rect) -> Column:
        return (F.greatest(self.x0, other.x0) < F.least(self.x1, other.x1)) & (F.greatest(self.y0, other.y0) < F.least(self.y1, other.y1))

    def contains_point(self, x, y) -> Column:
        n = self.normalize()
        return (n.x0 <= _col(x)) & (_col(x) <= n.x1) & (n.y0 <= _col(y)) & (_col(y) <= n.y1)

    def contains(self, other: Rect) -> Column:
        n = self.normalize()
        return other.is_empty() | ((n.x0 <= other.x0) & (n.y0 <= other.y0) & (other.x1 <= n.x1) & (other.y1 <= n.y1))

    def include_point(self, x, y) -> Rect:
        return Rect(F.least(self.x0, _col(x)), F.least(self.y0, _col(y)), F.greatest(self.x1, _col(x)), F.greatest(self.y1, _col(y)))

    def round(self) -> Rect:
        return Rect(F.floor(self.x0), F.floor(self.y0), F.ceil(self.x1), F.ceil(self.y1))

    def transform(self, m: Matrix) -> Rect:
        """Envelope of the four mapped corners."""
        corners = [m.point(x, y) for x in (self.x0, self.x1) for y in (self.y0, self.y1)]
        xs, ys = [c[0] for c in corners], [c[1] for c in corners]
        return Rect(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))

    def to_rect(self, other: Rect) -> Matrix:
        """The matrix that maps this rectangle onto another."""
        sx, sy = (other.x1 - other.x0) / (self.x1 - self.x0), (other.y1 - other.y0) / (self.y1 - self.y0)
        return Matrix(sx, F.lit(0.0), F.lit(0.0), sy, other.x0 - self.x0 * sx, other.y0 - self.y0 * sy)

    def distance_to(self, x, y) -> Column:
        dx = F.greatest(self.x0 - _col(x), _col(x) - self.x1, F.lit(0.0))
        dy = F.greatest(self.y0 - _col(y), _col(y) - self.y1, F.lit(0.0))
        return F.sqrt(dx * dx + dy * dy)


def iou(a: Rect, b: Rect) -> Column:
    """Overlap over union of two areas; 0 where neither has any."""
    w = F.greatest(F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0), F.lit(0.0))
    h = F.greatest(F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0), F.lit(0.0))
    both = w * h
    total = a.area() + b.area() - both
    return F.when(total > 0, both / total).otherwise(F.lit(0.0))


class IRect(Rect):
    """A rectangle of whole numbers; its union and intersection are such ones, too."""

    @staticmethod
    def around(r: Rect) -> IRect:
        """The least one that holds ``r``."""
        return IRect(*(c.cast("int") for c in (F.floor(r.x0), F.floor(r.y0), F.ceil(r.x1), F.ceil(r.y1))))

    def _whole(self, r: Rect) -> IRect:
        return IRect(*(c.cast("int") for c in (r.x0, r.y0, r.x1, r.y1)))

    def union(self, other: Rect) -> IRect:
        return self._whole(super().union(other))

    def intersect(self, other: Rect) -> IRect:
        return self._whole(super().intersect(other))


def norm(x, y) -> Column:
    """Length of a vector."""
    return F.hypot(_col(x), _col(y))


def unit(x, y) -> tuple[Column, Column]:
    """The vector of length 1 in the same direction; the null vector stays."""
    size = norm(x, y)
    return tuple(F.when(size > 0, _col(c) / F.when(size > 0, size)).otherwise(F.lit(0.0)) for c in (x, y))


@dataclass(frozen=True)
class Matrix:
    a: Column
    b: Column
    c: Column
    d: Column
    e: Column
    f: Column

    @staticmethod
    def of(*v) -> Matrix:
        return Matrix(*map(_col, v))

    @staticmethod
    def scale(sx, sy) -> Matrix:
        return Matrix.of(sx, 0, 0, sy, 0, 0)

    @staticmethod
    def translate(tx, ty) -> Matrix:
        return Matrix.of(1, 0, 0, 1, tx, ty)

    @staticmethod
    def shear(h, v) -> Matrix:
        return Matrix.of(1, v, h, 1, 0, 0)

    @staticmethod
    def rotate(degrees: float) -> Matrix:
        """Exact for multiples of 90."""
        exact = {0: (1, 0), 90: (0, 1), 180: (-1, 0), 270: (0, -1)}
        c, s = exact.get(degrees % 360) or (math.cos(math.radians(degrees)), math.sin(math.radians(degrees)))
        return Matrix.of(c, s, -s, c, 0, 0)

    def columns(self, prefix: str = "") -> list[Column]:
        return [c.alias(prefix + n) for c, n in zip((self.a, self.b, self.c, self.d, self.e, self.f), "abcdef", strict=True)]

    def then(self, o: Matrix) -> Matrix:
        """This map first, the other one after it."""
        return Matrix(
            self.a * o.a + self.b * o.c, self.a * o.b + self.b * o.d, self.c * o.a + self.d * o.c, self.c * o.b + self.d * o.d,
            self.e * o.a + self.f * o.c + o.e, self.e * o.b + self.f * o.d + o.f,
        )

    def determinant(self) -> Column:
        return self.a * self.d - self.b * self.c

    def invert(self) -> Matrix:
        """Null entries where the matrix is singular."""
        det = self.determinant()
        ok = lambda x: F.when(det != 0, x)
        inv = F.when(det != 0, 1 / F.when(det != 0, det))
        return Matrix(ok(self.d * inv), ok(-self.b * inv), ok(-self.c * inv), ok(self.a * inv), ok((self.c * self.f - self.d * self.e) * inv), ok((self.b * self.e - self.a * self.f) * inv))

    def point(self, x, y) -> tuple[Column, Column]:
        x, y = _col(x), _col(y)
        return x * self.a + y * self.c + self.e, x * self.b + y * self.d + self.f


def planish(x1, y1, x2, y2) -> Matrix:
    """The matrix that takes a segment's start to the origin and its end to the positive x axis."""
    c, s = unit(_col(x2) - _col(x1), _col(y2) - _col(y1))
    return Matrix.translate(-_col(x1), -_col(y1)).then(Matrix(c, -s, s, c, F.lit(0.0), F.lit(0.0)))


@dataclass(frozen=True)
class Quad:
    """Four corners, each (x, y): upper left, upper right, lower left, lower right."""

    ul: tuple[Column, Column]
    ur: tuple[Column, Column]
    ll: tuple[Column, Column]
    lr: tuple[Column, Column]

    @staticmethod
    def of(r: Rect) -> Quad:
        return Quad((r.x0, r.y0), (r.x1, r.y0), (r.x0, r.y1), (r.x1, r.y1))

    def corners(self) -> list[tuple[Column, Column]]:
        return [self.ul, self.ur, self.ll, self.lr]

    def columns(self, prefix: str = "") -> list[Column]:
        return [c.alias(f"{prefix}{n}_{a}") for n, p in zip(("ul", "ur", "ll", "lr"), self.corners(), strict=True) for a, c in zip("xy", p, strict=True)]

    def transform(self, m: Matrix) -> Quad:
        return Quad(*(m.point(x, y) for x, y in self.corners()))

    def rect(self) -> Rect:
        """The least rectangle around it."""
        xs, ys = zip(*self.corners(), strict=True)
        return Rect(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))

    def is_rectangular(self, slack: float = 1e-6) -> Column:
        """Whether the sides meet at right angles."""
        right = lambda o, p, q: F.abs((p[0] - o[0]) * (q[0] - o[0]) + (p[1] - o[1]) * (q[1] - o[1])) <= slack
        return right(self.ul, self.ur, self.ll) & right(self.ur, self.ul, self.lr) & right(self.ll, self.ul, self.lr)


def page_matrix(box: Rect, rotate: Column) -> Matrix:
    """User space (y up) to device space (y down, origin at the top left) of a turned page."""
    pick = lambda a, b, c, d: F.when(rotate == 90, _col(b)).when(rotate == 180, _col(c)).when(rotate == 270, _col(d)).otherwise(_col(a))
    return Matrix(
        pick(1, 0, -1, 0), pick(0, 1, 0, -1), pick(0, 1, 0, -1), pick(-1, 0, 1, 0),
        pick(-box.x0, -box.y0, box.x1, box.y1), pick(box.y1, -box.x0, -box.y0, box.x1),
    )


def page_size(box: Rect, rotate: Column) -> tuple[Column, Column]:
    w, h, turned = box.x1 - box.x0, box.y1 - box.y0, rotate.isin(90, 270)
    return F.when(turned, h).otherwise(w), F.when(turned, w).otherwise(h)


def paper_size(name: Column) -> tuple[Column, Column]:
    """Width and height by name, any case; -l or -landscape swaps them; null if unknown."""
    base = F.regexp_replace(F.lower(name), "-(l|landscape|p|portrait)$", "")
    flat = lambda k: F.create_map(*(F.lit(v) for n, s in PAPER.items() for v in (n, s[k])))
    w, h = F.try_element_at(flat(0), base), F.try_element_at(flat(1), base)
    wide = F.lower(name).rlike("-(l|landscape)$")
    return F.when(wide, h).otherwise(w), F.when(wide, w).otherwise(h)
