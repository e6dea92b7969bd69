"""Pairs that meet in blocks inside tasks."""

from __future__ import annotations

import random
import time
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyforge.functions.convex import shared_areas
from tallyforge.operators import blocks, registration


def quads(n, seed, groups=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        x, y, t, s = r.random(), r.random(), r.random() * 6, 3.0 if i % 7 == 0 else 1.0
        turn = lambda u, w: [x + s * (u * np.cos(t) - w * np.sin(t)), y + s * (u * np.sin(t) + w * np.cos(t))]  # noqa: E731, B023
        out.append((i % groups, i, [[float(c) for c in turn(u, w)] for u, w in ((-0.05, -0.07), (0.05, -0.07), (0.05, 0.07), (-0.05, 0.07))], i % 3))
    return out


SCHEMA = "g int, id long, quad array<array<double>>, identity int"


def test_shared_areas_of_many():
    """Against the share of a fine grid's points, either way round, equal and apart."""
    q = np.array([x[2] for x in quads(40, 3)])
    q[::2] = q[::2, ::-1]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(40), np.arange(40)))
    got = shared_areas(q, q, i, j)
    at = np.stack(np.meshgrid(np.linspace(-0.4, 1.4, 901), np.linspace(-0.4, 1.4, 901)), -1).reshape(-1, 2)

    def inside(p):
        sides = [(p[(k + 1) % 4] - p[k]) for k in range(4)]
        cross = np.array([s[0] * (at[:, 1] - p[k, 1]) - s[1] * (at[:, 0] - p[k, 0]) for k, s in enumerate(sides)])
        return (cross >= 0).all(axis=0) | (cross <= 0).all(axis=0)

    held = np.array([inside(p) for p in q], np.float32)
    want = (held @ held.T)[i, j] * (1.8 / 900) ** 2
    assert np.abs(got - want).max() < 2e-3 and abs(got[0] - 0.3 * 0.42) < 1e-12


def test_each_pair_meets_once(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("g"), "id")

    def run(a, b):
        x, y = a.column("id").to_numpy(), b.column("id").to_numpy()
        assert len(x) < 30 and len(y) < 30
        return pa.table([np.repeat(x, len(y)), np.tile(y, len(x))], ["a", "b"])

    rows = blocks.meet(df, df, ["g"], "id", run, "a long, b long", rows=8).collect()
    assert sorted((r.a, r.b) for r in rows) == [(a, b) for a in range(100) for b in range(100) if a % 2 == b % 2]


def test_f1_votes_of_a_crowded_picture(spark, monkeypatch):
    """1,200 quads that nearly all overlap; Spark's own expressions took minutes for their pairs."""
    monkeypatch.setattr(registration, "meet", partial(blocks.meet, rows=128))
    rows = [(0, i, [[x / 12, y / 12] for x, y in q], k) for _, i, q, k in quads(1200, 5)]
    d = spark.createDataFrame(rows, SCHEMA)
    maps = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0])], "g int, h array<double>")
    began = time.time()
    got = registration.map_votes(d.where("id % 2 = 0"), d.where("id % 2 = 1"), maps, ["g"], 0.1).collect()
    assert time.time() - began < 60
    a, b = [r for r in rows if r[1] % 2 == 0], [r for r in rows if r[1] % 2]
    p, q = np.array([r[2] for r in a]), np.array([r[2] for r in b])
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(a)), np.arange(len(b)), indexing="ij"))
    size = lambda z: np.array([0.126 if r[1] % 7 == 0 else 0.014 for r in z]) / 144
    overlap = (shared_areas(p, q, i, j) / np.minimum(size(a)[i], size(b)[j])).reshape(len(a), len(b))
    best = [(r[3], b[k][3]) for r, k, v in zip(a, np.round(overlap, 9).argmax(axis=1), overlap.max(axis=1), strict=True) if v >= 0.6]
    assert [(r.consistent, r.inconsistent) for r in got] == [(sum(x == y for x, y in best), sum(x != y for x, y in best))]


def test_f3_containment_of_a_crowded_picture(spark, monkeypatch):
    """the greedy choice among hundreds held, without a row for each two of them."""
    monkeypatch.setattr(registration, "HOLDERS", 5)
    rows = quads(400, 8)
    q = np.array([r[2] for r in rows])
    size = np.array([0.126 if i % 7 == 0 else 0.014 for i in range(400)])
    i, j = (x.ravel() for x in np.meshgrid(np.arange(400), np.arange(400), indexing="ij"))
    shared = shared_areas(q, q, i, j).reshape(400, 400)
    want = {}
    for h in range(0, 400, 7):
        loose = []
        for k in range(400):
            if size[k] < size[h] and shared[k, h] > 0.85 * size[k] and all(shared[k, x] < 0.2 * 0.014 for x in loose):
                loose.append(k)
        if len(loose) >= 3:
            want[h] = len(loose)
    got = registration.containment_groups(spark.createDataFrame(rows, SCHEMA), ["g"], 0.3).collect()
    assert {r.id: r.held for r in got} == want and len(want) > 20


def test_f7_f5_pairs_and_best_pairs_in_blocks(spark, monkeypatch):
    """each two quads once, whatever the blocks; the best of each, ties to the smaller id."""
    monkeypatch.setattr(registration, "meet", partial(blocks.meet, rows=16))
    rows = quads(150, 4)
    q = np.array([r[2] for r in rows])
    i, j = np.triu_indices(150, 1)
    shared = shared_areas(q, q, i, j)
    want = {(a, b): round(s, 9) for a, b, s in zip(i.tolist(), j.tolist(), shared.tolist(), strict=True) if s > 0}
    df = spark.createDataFrame(rows, SCHEMA)
    got = registration.quad_pairs(df, df, ["g"], 0.15, ordered=True).collect()
    assert {(r.a, r.b): round(r.shared, 9) for r in got} == want and len(got) == len(want)
    twice = df.unionByName(df.withColumn("id", F.col("id") + 1000))
    maps = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0])], "g int, h array<double>")
    met = registration.projected_matches(df, twice, maps, ["g"], 0.15).collect()
    assert len(met) == 150 and all(r.b < 1000 for r in met)
