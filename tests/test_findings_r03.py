"""Cases of the third round's findings."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tallyforge.operators import entity, graphs, nearest, pairing, rules, tables
from tallyforge.plans.registry import QUERIES


def test_f13_second_list_repeats_numbers(spark, tmp_path):
    """numbers above a million meet those of the second list; both rows stay, as in the SQL."""
    part = spark.createDataFrame([(1, "a", 1, 2.0), (1_000_001, "b", 10, 3.0), (2, "c", 30, 4.0)], "p_partkey long, p_name string, p_size int, p_retailprice double")
    part.write.parquet(f"{tmp_path}/part.parquet")
    rows = sorted(tuple(r) for r in QUERIES["upsert_catalog"](spark, str(tmp_path)).collect())
    assert rows == [(1, "a", 2.0), (2, "c", 8.0), (1_000_001, "a", 2.0), (1_000_001, "b", 3.0)]


def test_f8_replay_over_chunks(spark):
    """F8: the same replay whatever the chunks; a window that looked at all later rows took the square of a log's length."""
    r = random.Random(4)
    rows = [(c, i, r.choices(["add", "undo", "drop"], [6, 5, 0.1])[0], r.randrange(9), r.randrange(5)) for c in range(2) for i in range(300)]
    df = spark.createDataFrame(rows, "contest int, seq int, kind string, player int, amount long")
    want = sorted(map(tuple, graphs.replayed(df).collect()))
    assert want and sorted(map(tuple, graphs.replayed(df, size=7).collect())) == want
    done = []
    for _, at, kind, p, n in [x for x in rows if x[0] == 0]:
        shut = {x[3]: x[1] for x in reversed(rows) if x[0] == 0 and x[2] == "drop"}
        if kind == "undo":
            done = done[:-1]
        elif kind == "add" and at < shut.get(p, 1 << 30):
            done.append((p, n))
    assert sum(x[2] for x in want if x[0] == 0) == sum(n for _, n in done)
    assert "UnboundedFollowing" not in graphs.replayed(df)._jdf.queryExecution().toString() and "unboundedfollowing" not in graphs.replayed(df)._jdf.queryExecution().toString()


def test_f4_swaps_of_many_equal_sizes(spark):
    """every size often, on both sides; the rounds took one swap of a size each."""
    r = random.Random(6)
    for sizes in ([float(x) for x in range(5)], [x / 4 for x in range(24)]):
        rows = [(i, r.choice("tu"), r.choice(sizes) if r.random() < 0.9 else None, r.random() < 0.5) for i in range(260)]
        df = spark.createDataFrame(rows, "id int, g string, s double, m boolean")
        got = sorted((x.missing, x.extra, x.gap) for x in entity.greedy_swaps(df.where("m"), df.where("not m"), ["g"], "s").collect())
        offers = sorted((abs(a[2] - b[2]), a[0], b[0]) for a in rows for b in rows if a[3] and not b[3] and a[1] == b[1] and None not in (a[2], b[2]) and abs(a[2] - b[2]) <= 1)
        used, want = set(), []
        for gap, a, b in offers:
            if not {a, b} & used:
                used |= {a, b}
                want.append((a, b, gap))
        assert got == sorted(want)


def test_f9_f17_f22_crowded_pictures(spark, monkeypatch):
    """the nearest points of a crowd leave a task as k rows, whatever the blocks."""
    r = random.Random(2)
    points = [(0, i, r.random() / 5, r.random() / 5) for i in range(300)]
    df = spark.createDataFrame(points, "g int, id int, x double, y double")
    given, meet = [], nearest.meet

    def counted(*x):
        out = meet(*x, 64)
        given.append(out.count())
        return out

    monkeypatch.setattr(nearest, "meet", counted)
    got = sorted((x.id, x["rank"], x.other) for x in nearest.neighbours(df, "g", 0.2, 2).collect())
    want = [(i, n + 1, o) for _, i, x, y in points for n, (_, o) in enumerate(sorted((((x - u) ** 2 + (y - v) ** 2), o) for _, o, u, v in points if o != i)[:2])]
    assert got == sorted(want) and given[0] <= 300 * 2 * 2 * 6


def test_f18_suppression_from_the_best_on(spark):
    """the same boxes stay, whether pairs of all boxes are made or the best are settled first."""
    r = random.Random(8)
    rows = [(i % 2, i, x, y, x + 0.2, y + 0.2, r.choice([0.1, 0.4, 0.5, 0.9, None])) for i, (x, y) in enumerate((r.random(), r.random()) for _ in range(300))]
    df = spark.createDataFrame(rows, "g int, id int, left double, top double, right double, bottom double, score double")
    want = {(x.g, x.id) for x in graphs.suppressed(df, graphs.overlaps(df, df, ["g"], 0.2, 0.3).where("a < b"), ["g"]).collect()}
    got = [(x.g, x.id) for x in graphs.suppressed_in_cells(df, ["g"], 0.2, 0.3, first=15).collect()]
    assert set(got) == want and len(got) == len(want) < 200


def test_f2_f6_f23_rounds_inside_tasks(spark, monkeypatch):
    """contests are settled in a few jobs, not in rounds of joins; large ones in blocks, to the same optimum."""
    r, tables, written = random.Random(3), [], pairing.written
    monkeypatch.setattr(pairing, "written", lambda df: tables.append(1) or written(df))
    players = [(c, p, p, r.randrange(9)) for c, n in ((0, 24), (1, 121)) for p in range(n)]
    met = sorted({(c, *sorted(r.sample(range(n), 2)), r.randint(1, 3)) for c, n in ((0, 24), (1, 121)) for _ in range(4 * n)})
    met = [(*k, n) for k, n in {x[:3]: x[3] for x in met}.items()]
    df, known = spark.createDataFrame(players, "contest int, player int, rank int, points int"), spark.createDataFrame(met, "contest int, a int, b int, met int")
    times, points = {x[:3]: x[3] for x in met}, {x[:2]: x[3] for x in players}
    for places in (512, 34):
        monkeypatch.setattr(pairing, "PLACES", places)
        tables.clear()
        rows = pairing.swiss_pairs(df, known).collect()
        if places == 512:
            assert len(tables) <= 4
        for c, n in ((0, 24), (1, 121)):
            pairs = [(x.a, x.b) for x in rows if x.contest == c]
            assert sorted(-1 if x is None else x for p in pairs for x in p) == sorted([*range(n), *([-1] if n % 2 else [])])
            cost = lambda a, b: (0, (points[c, a if b is None else b] + 3) ** 2) if None in (a, b) else (times.get((c, min(a, b), max(a, b)), 0), (points[c, a] - points[c, b]) ** 2)  # noqa: E731, B023
            seat = {p: i for i, p in enumerate(sorted(range(n), key=lambda p: (-points[c, p], p)))}
            first = lambda p: min(seat.get(x, n) for x in p)  # noqa: E731, B023
            for (a, b), (u, v) in ((p, q) for p in pairs for q in pairs if first(p) < first(q) <= first(p) + 16 and None not in (*p, *q)):
                old = sum(cost(a, b)[0:1] + cost(u, v)[0:1]), cost(a, b)[1] + cost(u, v)[1]
                for one, two in (((a, u), (b, v)), ((a, v), (b, u))):
                    assert (cost(*one)[0] + cost(*two)[0], cost(*one)[1] + cost(*two)[1]) >= old
        tables.clear()
        seats = [(x.contest, x.player, x.pod) for x in pairing.pods(df, known).collect()]
        if places == 512:
            assert len(tables) <= 4
        assert sorted(x[:2] for x in seats) == sorted(x[:2] for x in players)
        sizes = {}
        for c, _, pod in seats:
            sizes[c, pod] = sizes.get((c, pod), 0) + 1
        assert sorted(sizes[0, k] for k in range(6)) == [4] * 6 and sorted(sizes[1, k] for k in range(31)) == [3] * 3 + [4] * 28


def test_f20_f21_copies_are_dealt_apart(spark):
    """rows of all keys stay in as many partitions as the session has, however well they compress."""
    df = spark.range(4000).selectExpr("id % 1000 as key", "id as position", "'x' as text", "2L as detected", "cast(null as long) as override")
    out = rules.limited(df, {"default": 3}, "key", [F.col("position")])
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    assert out.rdd.getNumPartitions() == n
    assert out.groupBy("key").agg(F.sum("quantity").alias("q")).where("q <> 3").count() == 0


def test_f24_lists_come_together_once(spark, sf):
    """one exchange of the lines serves both the choice of lines and the zones."""
    plan = QUERIES["parse_listing"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(l_orderkey") + plan.count("Exchange hashpartitioning(list") == 1


def test_f19_clusters_that_are_done_stay_out_of_later_rounds(spark, monkeypatch):
    """a long chain takes rounds; pairs that are done after the first one are not carried through them."""
    sizes, written = [], tables.written

    def counted(df):
        out = written(df)
        if out.columns == ["session", "id", "capture", "identity", "cluster"]:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(tables, "written", counted)
    at = spark.createDataFrame([(0, i, None, None) for i in range(20)] + [(s, i, None, None) for s in range(1, 40) for i in (0, 1)], "session int, id int, capture int, identity string")
    links = spark.createDataFrame([(0, i, i + 1, float(-i), False) for i in range(19)] + [(s, 0, 1, 1.0, False) for s in range(1, 40)], "session int, a int, b int, score double, forced boolean")
    rows = entity.constrained_clusters(at, links).collect()
    assert len(rows) == 98 and all(x.cluster == 0 for x in rows)
    assert sizes[0] == 98 and sizes[-1] <= 20
