"""Quads as arrays of four [x, y] points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _point(q: Column, i: int) -> tuple[Column, Column]:
    return q[i][0], q[i][1]


def area(q: Column) -> Column:
    """Polygon area by the shoelace formula."""
    total = F.lit(0.0)
    for i in range(4):
        (x0, y0), (x1, y1) = _point(q, i), _point(q, (i + 1) % 4)
        total = total + x0 * y1 - x1 * y0
    return F.abs(total) / 2


def centre(q: Column) -> Column:
    return F.array(*[sum((q[i][k] for i in range(1, 4)), q[0][k]) / 4 for k in (0, 1)])


def width(q: Column) -> Column:
    """Mean length of the top and the bottom side."""
    top = F.hypot(q[1][0] - q[0][0], q[1][1] - q[0][1])
    return (top + F.hypot(q[2][0] - q[3][0], q[2][1] - q[3][1])) / 2


def angle(q: Column) -> Column:
    """Direction of the top side in degrees, 0 to 180."""
    return F.pmod(F.degrees(F.atan2(q[1][1] - q[0][1], q[1][0] - q[0][0])), F.lit(180.0))


def box(q: Column) -> tuple[Column, Column, Column, Column]:
    """Left, top, right and bottom of the bounding box."""
    xs, ys = (F.array(*[q[i][k] for i in range(4)]) for k in (0, 1))
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def box_overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two quads' bounding boxes."""
    la, ta, ra, ba = box(a)
    lb, tb, rb, bb = box(b)
    both = F.greatest(F.lit(0.0), F.least(ra, rb) - F.greatest(la, lb)) * F.greatest(F.lit(0.0), F.least(ba, bb) - F.greatest(ta, tb))
    either = (ra - la) * (ba - ta) + (rb - lb) * (bb - tb) - both
    return F.when(either > 0, both / either).otherwise(0.0)


def circular_mean(degrees: Column, weight: Column) -> Column:
    """Aggregate: weighted mean of directions that repeat after 180 degrees."""
    r = F.radians(degrees) * 2
    return F.pmod(F.degrees(F.atan2(F.sum(weight * F.sin(r)), F.sum(weight * F.cos(r)))) / 2, F.lit(180.0))
