"""overlaps of many quads, measured in frames, found where the later box begins, and dealt by pieces, not by bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import convex
from tallyforge.operators import blocks, registration
from tallyforge.plans.scenes import to_places


def turned(n, seed, spread=0.12):
    r = np.random.default_rng(seed)
    t, s = r.normal(0, 0.5, n), np.where(np.arange(n) % 7 == 0, 3.0, 1.0)
    t[::5] = 0  # parallel sides
    u, w = np.array([-0.05, 0.05, 0.05, -0.05]), np.array([-0.07, -0.07, 0.07, 0.07])
    x, y = s[:, None] * (u * np.cos(t)[:, None] - w * np.sin(t)[:, None]), s[:, None] * (u * np.sin(t)[:, None] + w * np.cos(t)[:, None])
    return r.normal(0, spread, (n, 1, 2)) + np.stack([x, y], -1)


def both(n, m):
    return (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(m), indexing="ij"))


def test_f1_areas_in_frames(monkeypatch):
    """F1: each pair was cut side by side, some two microseconds each; in a frame none is."""
    p, q = turned(90, 1), turned(120, 2)
    p[1], p[2], p[3] = q[0], q[1][::-1], q[2] + [0.1, 0]  # equal, equal the other way round, beside
    q[::3] = q[::3, ::-1]
    p[4] = [[0, 0], [0.2, 0], [0.2, 0.2], [0, 0.2]]
    q[4], q[5], q[6] = p[4] + [0.2, 0], p[4] + [0.2, 0.2], p[4] * 0.5  # a side, a corner, two sides in common
    i, j = both(len(p), len(q))
    want = convex._shared(p[i], q[j])
    assert np.abs(convex.shared_areas(p, q, i, j) - want).max() < 1e-15
    assert ((convex.shared_areas(p, q, i, j) > 0) == (want > 0)).all()

    def cut(*_):
        raise AssertionError("cut")

    monkeypatch.setattr(convex, "_shared", cut)
    assert np.abs(convex.shared_areas(p, q, i, j, faint=False) - want).max() < 1e-15


@pytest.mark.parametrize("side", [0, 1])
def test_f1_quads_without_a_frame(side):
    """Where one side is no parallelogram the other's frame serves, and where neither is, or one is flat, they are cut."""
    p, q = turned(60, 3), turned(60, 4)
    (p, q)[side][:40, 2] += 0.02
    (p, q)[1 - side][30:50, 1] -= 0.01
    q[50:53, 1:] = q[50:53, :1]
    i, j = both(60, 60)
    want = convex._shared(p[i], q[j])
    assert np.abs(convex.shared_areas(p, q, i, j) - want).max() < 1e-15
    small = q * 1e-4
    assert np.allclose(convex.shared_areas(p, small, i, j), convex._shared(p[i], small[j]), rtol=1e-9, atol=0)
    assert (convex.shared_areas(p[:, :3], q[:, :3], i, j) == convex._shared(p[i][:, :3], q[j][:, :3])).all()


@pytest.mark.parametrize("cell", [0.07, 0.15, 2.0])
def test_f1_pairs_in_the_later_ones_cell(spark, monkeypatch, cell):
    """Each pair once, whatever the cells, the order or the least share asked for."""
    p, q = turned(80, 5), turned(90, 6)
    i, j = both(80, 90)
    shared = convex.shared_areas(p, q, i, j)
    area_p, area_q = np.abs(convex.signed_areas(p))[i], np.abs(convex.signed_areas(q))[j]
    a, b = (spark.createDataFrame([(0, k, x) for k, x in enumerate(z.tolist())], "g int, id long, quad array<array<double>>") for z in (p, q))
    for ordered, iou in ((False, 0.0), (True, 0.0), (False, 0.05), (True, 0.05)):
        want = [(x, y) for x, y, s, share in zip(i.tolist(), j.tolist(), shared, shared / (area_p + area_q - shared), strict=True) if s > 0 and share > iou and (x < y or not ordered)]
        got = registration.quad_pairs(a, b, ["g"], cell, ordered=ordered, iou=iou).select("a", "b").collect()
        assert sorted(map(tuple, got)) == want


def test_f1_compared_pairs_of_a_cell(monkeypatch):
    """quads that only reach into a cell were compared there with one another."""
    made, nonzero = [0], np.nonzero

    def counted(x):
        made[0] += x.size if x.ndim == 2 else 0
        return nonzero(x)

    monkeypatch.setattr(registration.np, "nonzero", counted)
    n = 200
    quads = np.tile(np.array([[-0.05, -0.05], [0.05, -0.05], [0.05, 0.05], [-0.05, 0.05]]), (n, 1, 1)) + np.linspace(0, 0.01, n)[:, None, None]
    at = pa.table({"g": pa.array(np.zeros(n, np.int32)), "id": pa.array(np.arange(n)), "quad": pa.array(quads.tolist(), pa.list_(pa.list_(pa.float64()))), "cx": pa.array(np.zeros(n, np.int64)), "cy": pa.array(np.zeros(n, np.int64))})
    assert registration._met_quads(at, at, ["g"], 0.2, False, True, 0.05).num_rows == 0 and made[0] == 0


def test_f1_pieces_are_dealt_by_number(spark):
    """pieces are small in bytes, so that adaptive execution put those of a cluster into one task."""
    df = spark.range(400).select((F.col("id") % 40).alias("g"), "id")
    rows = blocks.meet(df, df, ["g"], "id", lambda a, b: pa.table([a.column("id")], ["a"]), "a long")
    assert rows.select(F.spark_partition_id()).distinct().count() > 8


def test_f1_places(spark):
    rows = spark.range(1, 20000).select((F.col("id") / 20000.7).alias("x"))
    assert rows.where(to_places("x", 5) != F.round("x", 5)).count() == 0
