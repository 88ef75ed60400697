"""Points, affine matrices and colours as columns. A matrix is a struct (a, b, c, d, tx, ty) that maps row vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Determinants below this count as zero when a matrix is inverted.
EPSILON = 1e-10

Number = Column | float


def _c(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def matrix(a: Number, b: Number, c: Number, d: Number, tx: Number, ty: Number) -> Column:
    return F.struct(*(_c(v).cast("double").alias(n) for n, v in zip(("a", "b", "c", "d", "tx", "ty"), (a, b, c, d, tx, ty), strict=True)))


def translation(tx: Number, ty: Number) -> Column:
    return matrix(1, 0, 0, 1, tx, ty)


def scale(x: Number, y: Number) -> Column:
    return matrix(x, 0, 0, y, 0, 0)


def shear(x: Number, y: Number) -> Column:
    return matrix(1, y, x, 1, 0, 0)


def rotation(radians: Number) -> Column:
    s, c = F.sin(_c(radians)), F.cos(_c(radians))
    return matrix(c, s, -s, c, 0, 0)


def multiply(m: Column, n: Column) -> Column:
    """First m, then n."""
    g, h = m.getField, n.getField
    return matrix(
        g("a") * h("a") + g("b") * h("c"), g("a") * h("b") + g("b") * h("d"),
        g("c") * h("a") + g("d") * h("c"), g("c") * h("b") + g("d") * h("d"),
        g("tx") * h("a") + g("ty") * h("c") + h("tx"), g("tx") * h("b") + g("ty") * h("d") + h("ty"),
    )


def apply(m: Column, x: Number, y: Number) -> tuple[Column, Column]:
    g = m.getField
    return g("a") * _c(x) + g("c") * _c(y) + g("tx"), g("b") * _c(x) + g("d") * _c(y) + g("ty")


def determinant(m: Column) -> Column:
    g = m.getField
    return g("a") * g("d") - g("b") * g("c")


def inverse(m: Column) -> Column:
    """The inverse, or null if the matrix is singular."""
    g, det = m.getField, determinant(m)
    k = F.lit(1.0) / F.when(F.abs(det) > EPSILON, det)
    made = matrix(g("d") * k, -g("b") * k, -g("c") * k, g("a") * k, (g("c") * g("ty") - g("d") * g("tx")) * k, (g("b") * g("tx") - g("a") * g("ty")) * k)
    return F.when(F.abs(det) > EPSILON, made)


def angle(m: Column) -> Column:
    """Rotation in degrees, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(-m.getField("b"), m.getField("a"))), F.lit(360.0))


def scaling(m: Column) -> tuple[Column, Column]:
    g = m.getField
    return F.hypot(g("a"), g("b")), F.hypot(g("c"), g("d"))


def round_to(x: Column, precision: float) -> Column:
    """To a multiple of the precision."""
    return F.round(x / precision) * precision


def round_matrix(m: Column, precision: float) -> Column:
    """Every entry to a multiple of the precision."""
    return matrix(*(round_to(m.getField(n), precision) for n in ("a", "b", "c", "d", "tx", "ty")))


def rotate_point(x: Number, y: Number, degrees: Number) -> tuple[Column, Column]:
    """A point turned about the origin; the angle is in degrees."""
    return apply(rotation(F.radians(_c(degrees))), x, y)


def displace(x: Number, y: Number, dx: Number, dy: Number) -> tuple[Column, Column]:
    return _c(x) + _c(dx), _c(y) + _c(dy)


def magnitude(x: Number, y: Number) -> Column:
    return F.hypot(_c(x), _c(y))


def polar_angle(x: Number, y: Number) -> Column:
    """A vector's angle in radians, in (-pi, pi]."""
    return F.atan2(_c(y), _c(x))


def scale_vector(x: Number, y: Number, factor: Number) -> tuple[Column, Column]:
    return _c(x) * _c(factor), _c(y) * _c(factor)


def from_polar(length: Number, radians: Number) -> tuple[Column, Column]:
    return _c(length) * F.cos(_c(radians)), _c(length) * F.sin(_c(radians))


def distance(x0: Number, y0: Number, x1: Number, y1: Number) -> Column:
    return F.hypot(_c(x0) - _c(x1), _c(y0) - _c(y1))


def lerp(a: Number, b: Number, t: Number) -> Column:
    return _c(a) + (_c(b) - _c(a)) * _c(t)


def remap(x: Number, xmin: Number, xmax: Number, ymin: Number, ymax: Number) -> Column:
    """x from one range to another; ymin if the first range is empty."""
    width = _c(xmax) - _c(xmin)
    return F.when(F.abs(width) < EPSILON, _c(ymin)).otherwise(_c(ymin) + (_c(x) - _c(xmin)) * (_c(ymax) - _c(ymin)) / F.when(F.abs(width) >= EPSILON, width))


def rgb_to_gray(r: Number, g: Number, b: Number) -> Column:
    return _c(r) * 0.3 + _c(g) * 0.59 + _c(b) * 0.11


def cmyk_to_gray(c: Number, m: Number, y: Number, k: Number) -> Column:
    return 1.0 - F.least(F.lit(1.0), _c(c) * 0.3 + _c(m) * 0.59 + _c(y) * 0.11 + _c(k))


def cubic_bounds(p0: Column, p1: Column, p2: Column, p3: Column) -> tuple[Column, Column]:
    """Least and greatest coordinate of a cubic curve, from the roots of its derivative."""
    a, b, c = -p0 + 3 * p1 - 3 * p2 + p3, 2 * (p0 - 2 * p1 + p2), p1 - p0
    disc = b * b - 4 * a * c
    root = F.sqrt(F.when(disc >= 0, disc))
    quadratic = F.abs(a) > EPSILON
    ts = [
        F.when(quadratic, (-b + root) / F.when(quadratic, 2 * a)),
        F.when(quadratic, (-b - root) / F.when(quadratic, 2 * a)),
        F.when(~quadratic & (F.abs(b) > EPSILON), -c / F.when(F.abs(b) > EPSILON, b)),
    ]

    def at(t: Column) -> Column:
        u = 1 - t
        return F.when((t > 0) & (t < 1), u * u * u * p0 + 3 * u * u * t * p1 + 3 * u * t * t * p2 + t * t * t * p3)

    points = [p0, p3, *(at(t) for t in ts)]
    return F.least(*points), F.greatest(*points)
