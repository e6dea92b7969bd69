from __future__ import annotations

import pytest

from tallyforge.streaming.watching import Watcher, corners, frame_kinds, holds, overlap


def square(x, y, side=100.0):
    x, y = float(x), float(y)
    return [x, y, x + side, y, x + side, y + side, x, y + side]


def kinds(*frames):
    m, out = Watcher(), []
    for i, (quad, sharp) in enumerate(frames):
        out += m.take(i, quad, sharp, 1.0, 0)
    return [(k, n) for _, k, n in out]


def test_geometry():
    a, b = corners(square(0, 0)), corners(square(50, 0))
    assert overlap(a, b) == pytest.approx(1 / 3) and overlap(a, b[::-1]) == pytest.approx(1 / 3)
    assert overlap(a, corners(square(200, 0))) == 0 and overlap(a, a) == pytest.approx(1)
    assert holds(a, (100, 50)) and holds(a[::-1], (1, 1)) and not holds(a, (101, 50))


def test_motion_and_sharpness():
    still = (square(0, 0), 50.0)
    assert kinds(still, still) == [("stable", 1), ("stable", 1)]
    assert [k for k, _ in kinds(still, (square(9, 0), 50.0), (square(24, 0), 50.0), (square(60, 0), 50.0))] == ["stable", "stable", "unstable", "fast"]
    assert [k for k, _ in kinds(still, (square(0, 0), 21.0), (None, None), still)] == ["stable", "unstable", "empty", "stable"]
    # a fifth of the median sharpness, once there are two frames
    assert [k for k, _ in kinds((square(0, 0), 200.0), (square(0, 0), 30.0))] == ["stable", "stable"]
    assert [k for k, _ in kinds(*[(square(0, 0), 200.0)] * 2, (square(0, 0), 30.0))] == ["stable", "stable", "unstable"]


def test_size_against_the_median():
    still = (square(0, 0), 50.0)
    assert [k for k, _ in kinds(still, still, (square(30, 30, 50.0), 50.0))][-1] == "unstable"  # small, inside
    assert [k for k, _ in kinds(still, still, (square(200, 0, 50.0), 50.0))][-1] == "fast"  # small, elsewhere
    assert [k for k, _ in kinds(still, still, (square(0, 0, 130.0), 50.0))][-1] == "fast"
    assert [k for k, _ in kinds(still, (square(0, 0, 130.0), 50.0))][-1] == "unstable"  # one frame is no median: motion decides


def test_medians_begin_anew_with_a_group():
    still = (square(0, 0), 50.0)
    got = kinds(still, still, (None, 0.0), (None, 0.0), (square(0, 0, 200.0), 50.0), (square(0, 0, 200.0), 50.0))
    assert got == [("stable", 1), ("stable", 1), ("empty", 1), ("empty", 0), ("stable", 2), ("stable", 2)]


def test_shifted_after_shaking_is_another_group():
    got = kinds((square(0, 0), 50.0), (square(15, 0), 50.0), (square(24, 0), 50.0))
    assert got == [("stable", 1), ("unstable", 1), ("stable", 2)]


def test_frames_as_a_table(spark):
    rows = [(1, i, q, 50.0, 1.0, 0) for i, q in enumerate([square(0, 0), square(1, 0), None, [1.0]])] + [(None, 0, None, None, None, None)]
    df = spark.createDataFrame(rows, "capture long, idx long, quad array<double>, sharp double, score double, sig long")
    got = sorted(((r.capture or 0), r.idx, r.kind, r.number) for r in frame_kinds(df).collect())
    assert got == [(0, 0, "empty", 0), (1, 0, "stable", 1), (1, 1, "stable", 1), (1, 2, "empty", 1), (1, 3, "empty", 0)]
    assert frame_kinds(df.where("false")).count() == 0
