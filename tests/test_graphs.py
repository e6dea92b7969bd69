from __future__ import annotations

import itertools
import random

from tallyforge.operators.graphs import overlaps, replayed, spanning_forest, suppressed

BOX = "g int, id int, left double, top double, right double, bottom double, score double"


def boxes(seed, n=40):
    r = random.Random(seed)
    out = []
    for i in range(n):
        x, y = r.random(), r.random()
        out.append((i % 2, i, x, y, x + 0.3, y + 0.2, r.choice([0.1, 0.5, 0.9])))
    return out


def iou(a, b):
    w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
    both = max(0, w) * max(0, h)
    return both / (2 * 0.3 * 0.2 - both)


def test_overlaps_and_suppression(spark):
    rows = boxes(1)
    df = spark.createDataFrame(rows, BOX)
    pairs = overlaps(df, df, ["g"], 0.17, 0.3).where("a < b")
    want = {(a[1], b[1]) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and iou(a, b) >= 0.3}
    assert {(r.a, r.b) for r in pairs.collect()} == want and want
    kept = []
    for b in sorted(rows, key=lambda b: (-b[6], b[1])):
        if not any((min(k[1], b[1]), max(k[1], b[1])) in want for k in kept):
            kept.append(b)
    assert {r.id for r in suppressed(df, pairs, ["g"]).collect()} == {k[1] for k in kept}


def test_spanning_forest(spark):
    for seed in range(3):
        r = random.Random(seed)
        edges = [(r.randrange(18), r.randrange(18), r.randrange(1, 6)) for _ in range(40)]
        got = [(x.a, x.b, x.weight) for x in spanning_forest(spark.createDataFrame(edges, "a long, b long, weight long")).collect()]
        root = {x: x for e in edges for x in e[:2]}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        want = []
        best = {}
        for a, b, w in edges:
            if a != b:
                best[min(a, b), max(a, b)] = max(w, best.get((min(a, b), max(a, b)), 0))
        for (a, b), w in sorted(best.items(), key=lambda x: (-x[1], x[0])):
            if find(a) != find(b):
                root[find(a)] = find(b)
                want.append((a, b, w))
        assert sorted(got) == sorted(want)


def test_replay(spark):
    r = random.Random(11)
    rows = [(c, i, r.choices(["add", "undo", "drop"], [6, 3, 1])[0], r.randrange(3), r.randrange(5)) for c in range(4) for i in range(40)]
    got = {(x.contest, x.player): (x.score, x.changes) for x in replayed(spark.createDataFrame(rows, "contest int, seq int, kind string, player int, amount long")).collect()}
    want = {}
    for c in range(4):
        done, shut = [], set()
        for _, _, kind, p, n in [x for x in rows if x[0] == c]:
            if kind == "drop":
                shut.add(p)
            elif kind == "undo":
                done = done[:-1]
            elif p not in shut:
                done.append((p, n))
        for p in {p for p, _ in done}:
            want[c, p] = (sum(n for q, n in done if q == p), sum(q == p for q, _ in done))
    assert got == want
