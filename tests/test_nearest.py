from __future__ import annotations

import random

import pytest

import tallyforge.operators.nearest as module
from tallyforge.operators.nearest import nearest

SCHEMA = "id long, art array<long>, full array<long>, bonus double, item string"


def bits(a, b):
    return sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a, b, strict=True))


def scan(rows, queries, k, distinct=False):
    out = []
    for q in queries:
        scores = sorted((bits(r[1], q[1]) + 0.5 * bits(r[2], q[2]) - (r[3] or 0.0), r[4] if distinct else r[0], r[0]) for r in rows if r[0] != q[0])
        taken = {}
        for score, key, i in scores:
            taken.setdefault(key, (q[0], i, score))
        out += [(*t, n + 1) for n, t in enumerate(sorted(taken.values(), key=lambda t: (t[2], next(r[4] for r in rows if r[0] == t[1]) if distinct else t[1]))[:k])]
    return sorted(out)


def planted(words, seed, near):
    """Families of signatures a few bits apart, copies among them."""
    r = random.Random(seed)
    long = lambda: r.getrandbits(64) - (1 << 63)
    flip = lambda s, n: [w ^ sum(1 << b for b in set(r.choices(range(63), k=n))) for w in s]
    rows = []
    for family in range(12):
        art, full = [long() for _ in range(words)], [long() for _ in range(words)]
        rows += [(family * 10 + i, flip(art, r.choice(near)), flip(full, r.choice(near)), r.choice([0.0, 2.0, None]), r.choice("abc")) for i in range(10)]
    return rows


@pytest.mark.parametrize(("words", "near", "distinct"), [(1, [0, 1, 2], False), (4, [0, 1, 3], False), (1, [0, 2, 9], True)])
def test_equals_a_scan(spark, words, near, distinct):
    rows = planted(words, 5 + words, near)
    df = spark.createDataFrame(rows, SCHEMA)
    report = []
    got = nearest(df, df.where("id % 3 = 0"), 3, "item" if distinct else None, words, report, "item" if distinct else "id").collect()
    assert sorted((r.query_id, r.id, r.score, r.rank) for r in got) == scan(rows, [r for r in rows if r[0] % 3 == 0], 3, distinct)
    if words == 4:
        assert report[0][2] == 0 and report[0][1] < 40 * len(rows) / 4  # families are met without the rest
    if distinct:
        assert report[-1][0] == 16  # some have nothing near, and are as right
    assert sum(r[1] for r in report) <= 40 * len(rows)  # no pair is scored twice


def test_blocks_of_open_queries(spark, monkeypatch):
    monkeypatch.setattr(module, "BLOCK", 7)
    rows = planted(1, 11, [5, 9, 20])
    df = spark.createDataFrame(rows, SCHEMA)
    got = nearest(df, df.where("id % 4 = 0"), 4).collect()
    assert sorted((r.query_id, r.id, r.score, r.rank) for r in got) == scan(rows, [r for r in rows if r[0] % 4 == 0], 4)


def test_copies_ties_nulls_and_empty(spark):
    rows = [(i, [7], [9], 0.0, "a") for i in range(40)] + [(90, None, [1], 0.0, "b"), (91, [None], [1], 0.0, "b"), (92, [1, 2], [1], 0.0, "b"), (93, [8], [9], None, "b")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = nearest(df, df.where("id in (0, 39, 90, 91, 92)"), 3).collect()
    assert sorted((r.query_id, r.rank, r.id, r.score) for r in got) == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 3, 0.0), (39, 1, 0, 0.0), (39, 2, 1, 0.0), (39, 3, 2, 0.0)]
    few = nearest(df.where("id in (1, 93)"), df.where("id = 1"), 5).collect()
    assert [(r.id, r.score, r.rank) for r in few] == [(93, 4.0, 1)]
    assert nearest(df.where("false"), df, 3).count() == 0 and nearest(df, df.where("false"), 3).count() == 0


@pytest.mark.parametrize("distinct", [False, True])
def test_scan_of_blocks_without_probes(spark, monkeypatch, distinct):
    """Random signatures meet in blocks of both sides; a block gives no more than can be among the best."""
    monkeypatch.setattr(module, "BLOCK", 9)
    monkeypatch.setattr(module, "ROWS", 50)
    monkeypatch.setattr(module, "LEAST", 0)
    rows = planted(2, 21, [0, 9, 20])
    df = spark.createDataFrame(rows, SCHEMA)
    given, meet = [], module.meet

    def counted(*x):
        out = meet(*x)
        given.append(out.count())
        return out

    monkeypatch.setattr(module, "meet", counted)
    report = []
    got = nearest(df, df.where("id % 3 = 0"), 2, "item" if distinct else None, 2, report, "item" if distinct else "id").collect()
    assert sorted((r.query_id, r.id, r.score, r.rank) for r in got) == scan(rows, [r for r in rows if r[0] % 3 == 0], 2, distinct)
    assert [r[0] for r in report] == [16] and given[0] <= 40 * 6 * 4
    assert nearest(df, df.where("false"), 2, None, 2).count() == 0
