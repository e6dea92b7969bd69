"""Kinds of frames from what is seen in them: a quad, how sharp it is, and the frames of the open group before it.

Frames have capture, idx, quad (four corners in order, eight numbers; null if nothing is seen), sharp, score and sig (a
long). A quad of null or fewer numbers counts as none; null sharpness, score and signature as 0.
"""

from __future__ import annotations

import math
import statistics

from pyspark.sql import DataFrame

from .carried import carried
from .segments import Segmenter

OUT = "capture long, idx long, kind string, number int"
#: Fixed values of the rules: shares of the card's width, of the median area, and sharpness.
STILL, FAST, SMALL, LARGE, SHARP, BLURRED = 0.10, 0.25, 0.65, 1.5, 22.0, 0.2
#: Frames that medians look back on.
MEDIAN = 15

Point = tuple[float, float]


def corners(quad: list[float]) -> list[Point]:
    return list(zip(quad[0:8:2], quad[1:8:2], strict=True))


def _side(a: Point, b: Point, p: Point) -> float:
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def area(points: list[Point]) -> float:
    """Signed; positive for corners that go round from x to y."""
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(points, [*points[1:], *points[:1]], strict=True)) / 2


def centre(points: list[Point]) -> Point:
    return sum(p[0] for p in points) / 4, sum(p[1] for p in points) / 4


def holds(points: list[Point], p: Point) -> bool:
    """Whether a convex quad has the point in it or on its edge."""
    sides = [_side(a, b, p) for a, b in zip(points, [*points[1:], points[0]], strict=True)]
    return all(s >= 0 for s in sides) or all(s <= 0 for s in sides)


def overlap(one: list[Point], two: list[Point]) -> float:
    """Common share of two convex quads' union."""
    ring = two if area(two) >= 0 else two[::-1]
    left = one
    for a, b in zip(ring, [*ring[1:], ring[0]], strict=True):
        kept: list[Point] = []
        for p, q in zip(left, [*left[1:], *left[:1]], strict=True):
            sp, sq = _side(a, b, p), _side(a, b, q)
            if (sp >= 0) != (sq >= 0):
                t = sp / (sp - sq)
                kept.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
            if sq >= 0:
                kept.append(q)
        left = kept
    both = abs(area(left)) if left else 0.0
    union = abs(area(one)) + abs(area(two)) - both
    return both / union if union else 0.0


class Watcher(Segmenter):
    """The segment machine, fed with kinds that it finds itself; quads are its places and its best frame's signature is
    what others are compared with. The state is bounded: 15 areas and sharpnesses, two quads."""

    def __init__(self, split: int = 25) -> None:
        super().__init__(split)
        self.areas: list[float] = []
        self.sharps: list[float] = []
        self.before: Point | None = None
        self.still: list[Point] | None = None
        self.best = -1.0

    def overlap(self, x, before) -> float:
        return overlap(x, before)

    def kind(self, points: list[Point] | None, sharp: float) -> str:
        if points is None:
            self.before = None
            return "empty"
        size, at = abs(area(points)), centre(points)
        known = self.frames > 0 and len(self.areas) >= 2
        if known:
            middle = statistics.median(self.areas)
            if not SMALL * middle <= size <= LARGE * middle:
                # a smaller outline within the still card is a fault of the detector, any other is a card on its way
                return "unstable" if size < SMALL * middle and holds(self.still, at) else "fast"
        width = (math.dist(points[0], points[1]) + math.dist(points[3], points[2])) / 2
        motion = math.dist(at, self.before) / max(width, 1.0) if self.before else 0.0
        self.before = at
        if motion > STILL:
            return "fast" if motion > FAST else "unstable"
        return "stable" if sharp >= SHARP and (not known or sharp >= BLURRED * statistics.median(self.sharps)) else "unstable"

    def take(self, idx: int, quad: list | None, sharp: float | None, score: float | None, sig: int | None) -> list[tuple]:
        whole = quad is not None and len(quad) >= 8 and None not in quad[:8]
        points, sharp, score, sig = corners(quad) if whole else None, sharp or 0.0, score or 0.0, sig or 0
        kind = self.kind(points, sharp)
        reference = self.sig
        self.push(idx, kind, sig, points)
        if kind == "stable":
            if self.frames == 1:
                self.areas, self.sharps, self.best = [], [], -1.0
            if score > self.best:
                self.best = score
            else:
                self.sig = reference
            self.areas, self.sharps, self.still = [*self.areas, abs(area(points))][-MEDIAN:], [*self.sharps, sharp][-MEDIAN:], points
        return [(idx, kind, self.number + 1 if self.frames else 0)]

    def end(self) -> list[tuple]:
        return []


def frame_kinds(frames: DataFrame, split: int = 25) -> DataFrame:
    """Every frame's kind (empty, fast, unstable, stable) and the number of the group that is open after it (0: none)."""
    return carried(frames.select("capture", "idx", "quad", "sharp", "score", "sig"), "capture", ["idx"], lambda: Watcher(split), OUT)
