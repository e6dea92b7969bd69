"""Projective maps as arrays of nine numbers (row by row) and convex polygons as arrays of [x, y] points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTITY = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]


def normalised(m: Column) -> Column:
    return F.transform(m, lambda x: x / m[8])


def composed(m: Column, n: Column) -> Column:
    """First ``n``, then ``m``."""
    return normalised(F.array(*[m[3 * i] * n[j] + m[3 * i + 1] * n[3 + j] + m[3 * i + 2] * n[6 + j] for i in range(3) for j in range(3)]))


def inverse(m: Column) -> Column:
    """The inverse map; a map's scale does not matter, so the adjugate will do."""
    cells = [(4, 8, 5, 7), (2, 7, 1, 8), (1, 5, 2, 4), (5, 6, 3, 8), (0, 8, 2, 6), (2, 3, 0, 5), (3, 7, 4, 6), (1, 6, 0, 7), (0, 4, 1, 3)]
    return normalised(F.array(*[m[a] * m[b] - m[c] * m[d] for a, b, c, d in cells]))


def projected(m: Column, polygon: Column) -> Column:
    """The images of a polygon's points."""

    def image(p: Column) -> Column:
        w = m[6] * p[0] + m[7] * p[1] + m[8]
        return F.array((m[0] * p[0] + m[1] * p[1] + m[2]) / w, (m[3] * p[0] + m[4] * p[1] + m[5]) / w)

    return F.transform(polygon, image)


def _next(polygon: Column, i: Column) -> Column:
    return polygon[(i + 1) % F.size(polygon)]


def signed_area(polygon: Column) -> Column:
    """Positive if the points go round in the direction from x to y; 0 with no point."""
    at = F.filter(F.sequence(F.lit(0), F.size(polygon)), lambda i: i < F.size(polygon))
    return F.aggregate(at, F.lit(0.0), lambda s, i: s + polygon[i][0] * _next(polygon, i)[1] - _next(polygon, i)[0] * polygon[i][1]) / 2


def _cut(polygon: Column, a: Column, b: Column) -> Column:
    """What of a convex polygon lies to the left of the line from ``a`` to ``b``."""
    side = lambda p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])

    def step(i: Column) -> Column:
        p, q = polygon[i], _next(polygon, i)
        t = side(p) / (side(p) - side(q))  # only where the sides differ
        meet = F.array(p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1]))
        inside, then = side(p) >= 0, side(q) >= 0
        return F.when(inside & then, F.array(q)).when(inside, F.array(meet)).when(then, F.array(meet, q)).otherwise(F.array().cast("array<array<double>>"))

    at = F.filter(F.sequence(F.lit(0), F.size(polygon)), lambda i: i < F.size(polygon))
    return F.flatten(F.transform(at, step))


def _with(x: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.transform(F.array(x), f)[0]


def common_area(a: Column, b: Column) -> Column:
    """The area that two convex quads share; each may go round either way."""
    around = F.when(signed_area(b) >= 0, b).otherwise(F.reverse(b))
    clipped = _with(around, lambda q: F.aggregate(F.sequence(F.lit(0), F.lit(3)), a, lambda left, i: _with(left, lambda p: _cut(p, q[i], _next(q, i)))))
    return F.abs(_with(clipped, signed_area))
