"""Pairs against the cheapest of all matchings, tables against repeats and repeated small tables."""

from __future__ import annotations

import random
from functools import cache
from itertools import combinations

from tallyforge.operators import pairing

PLAYERS = "contest int, player int, rank int, points int, byes int"
MET = "contest int, a int, b int, met int"


def made(contests, sizes, rounds, seed):
    """Contests after some rounds of random pairs, with points by results."""
    rng = random.Random(seed)
    players, met = [], []
    for c in range(contests):
        n = sizes[c % len(sizes)]
        points, byes, pairs = [0] * n, [0] * n, {}
        for _ in range(rounds):
            order = rng.sample(range(n), n)
            for a, b in zip(order[::2], order[1::2], strict=False):
                pairs[min(a, b), max(a, b)] = pairs.get((min(a, b), max(a, b)), 0) + 1
                points[rng.choice((a, b))] += 3
            if n % 2:
                byes[order[-1]] += 1
                points[order[-1]] += 3
        order = sorted(range(n), key=lambda p: (-points[p], p))
        players += [(c, p, order.index(p) + 1, points[p], byes[p]) for p in range(n)]
        met += [(c, a, b, m) for (a, b), m in pairs.items()]
    return players, met


def costs(players, met, c):
    mine = {p: (pts, bye) for cc, p, _, pts, bye in players if cc == c}
    times = {(a, b): m for cc, a, b, m in met if cc == c}
    low = min(pts for pts, _ in mine.values()) - pairing.BYE_GAP

    def cost(a, b):
        if b is None:
            return mine[a][1], (mine[a][0] - low) ** 2
        return times.get((min(a, b), max(a, b)), 0), (mine[a][0] - mine[b][0]) ** 2

    return sorted(mine), cost


def cheapest(ids, cost):
    seats = [*ids, *([None] if len(ids) % 2 else [])]
    n = len(seats)

    @cache
    def best(used):
        if used == (1 << n) - 1:
            return 0, 0
        i = next(i for i in range(n) if not used >> i & 1)
        out = None
        for j in range(i + 1, n):
            if not used >> j & 1:
                met, gap = best(used | 1 << i | 1 << j)
                c = cost(seats[i], seats[j])
                out = min(out or (9**9, 0), (met + c[0], gap + c[1]))
        return out

    return best(0)


def checked(rows, players, met, c):
    ids, cost = costs(players, met, c)
    mine = [r for r in rows if r.contest == c]
    assert sorted(x for r in mine for x in (r.a, r.b) if x is not None) == ids and sum(r.b is None for r in mine) == len(ids) % 2
    each = [cost(r.a, r.b) if r.a is not None else cost(r.b, None) for r in mine]
    assert [(r.met, r.gap) for r in mine] == each
    return sum(m for m, _ in each), sum(g for _, g in each)


def test_as_cheap_as_the_cheapest(spark):
    few, many = made(20, [8, 9, 10, 11, 12], 3, 3), made(30, [8, 9, 10, 11, 12], 6, 6)
    players, met = few[0] + [(c + 20, *x) for c, *x in many[0]], few[1] + [(c + 20, *x) for c, *x in many[1]]
    rows = pairing.swiss_pairs(spark.createDataFrame(players, PLAYERS), spark.createDataFrame(met, MET)).collect()
    for c in range(50):
        (again, gap), (least, least_gap) = checked(rows, players, met, c), cheapest(*costs(players, met, c))
        assert again == least and gap <= 1.02 * least_gap


def test_never_above_greedy_pairs(spark):
    players, met = made(2, [128, 129], 7, 1)
    rows = pairing.swiss_pairs(spark.createDataFrame(players, PLAYERS), spark.createDataFrame(met, MET)).collect()
    for c in range(2):
        ids, cost = costs(players, met, c)
        left, greedy = [p for _, p in sorted((r, p) for cc, p, r, _, _ in players if cc == c)], []
        while left:
            a = left.pop(0)
            b = min(left, key=lambda b: cost(a, b)) if left else None
            greedy.append(cost(a, b))
            if b is not None:
                left.remove(b)
        again, gap = checked(rows, players, met, c)
        assert again == 0 and (again, gap) <= (sum(m for m, _ in greedy), sum(g for _, g in greedy))


def test_pairs_of_a_last_round_follow_the_ranks(spark):
    players = [(0, p, p + 1, 0, 0) for p in range(8)]
    met = [(0, 0, 1, 1)]
    rows = pairing.swiss_pairs(spark.createDataFrame(players, PLAYERS), spark.createDataFrame(met, MET), final=True).collect()
    assert {frozenset((r.a, r.b)) for r in rows} in ({frozenset(x) for x in ((0, 2), (1, 3), (4, 5), (6, 7))}, {frozenset(x) for x in ((0, 3), (1, 2), (4, 5), (6, 7))})


def test_few_players_and_the_first_round(spark):
    players = spark.createDataFrame([(0, 1, 1, 0, 2), (1, 1, 1, 0, 0), (1, 2, 2, 3, 0)], PLAYERS)
    assert {(r.contest, r.a, r.b) for r in pairing.swiss_pairs(players, spark.createDataFrame([(5, 1, 2, 1), (1, 1, 9, 1)], MET)).collect()} == {(0, 1, None), (1, 2, 1)}
    assert pairing.swiss_pairs(players.where("false"), spark.createDataFrame([], MET)).count() == 0
    many = spark.createDataFrame([(c, p, p, 0, 0) for c in range(2) for p in range(7 + c)], PLAYERS)
    draws = [{(r.contest, r.a, r.b) for r in pairing.first_pairs(many, seed).collect()} for seed in (1, 1, 2)]
    assert draws[0] == draws[1] != draws[2]
    assert sorted(x for c, a, b in draws[0] if c == 0 for x in (a, b) if x is not None) == list(range(7)) and sum(b is None for _, _, b in draws[0]) == 1


def tables(rows):
    out = {}
    for r in rows:
        out.setdefault((r.contest, r.pod), []).append(r.player)
    return out


def test_tables_without_repeats(spark):
    """24 players over three rounds, several contests: nobody meets twice."""
    met, points = {}, {}
    for turn in range(3):
        rows = [(c, p, p, points.get((c, p), 0), 0) for c in range(2) for p in range(24)]
        known = spark.createDataFrame([(c, a, b, m) for (c, a, b), m in met.items()], MET) if met else None
        now = tables(pairing.pods(spark.createDataFrame(rows, "contest int, player int, rank int, points int, small int"), known).collect())
        assert sorted(map(len, now.values())) == [4] * 12
        for (c, _), who in now.items():
            for a, b in combinations(sorted(who), 2):
                met[c, a, b] = met.get((c, a, b), 0) + 1
            points[c, who[turn]] = points.get((c, who[turn]), 0) + 7
    assert max(met.values()) == 1


def test_small_tables_are_not_taken_twice(spark):
    """Ten players, tables of 4, 3 and 3: the six who sat at a small one do not all sit there again."""
    rows = [(0, p, p, 0, int(p < 6)) for p in range(10)]
    met = [(0, a, b, 1) for a, b in combinations(range(10), 2) if (a < 3) == (b < 3) and (a < 6) == (b < 6)]
    now = tables(pairing.pods(spark.createDataFrame(rows, "contest int, player int, rank int, points int, small int"), spark.createDataFrame(met, MET)).collect())
    assert sorted(map(len, now.values())) == [3, 3, 4]
    again = lambda split: sum((0, *sorted(p)) in {(0, a, b) for _, a, b, _ in met} for who in split for p in combinations(who, 2))
    small = lambda split: sum(p < 6 for who in split for p in who if len(who) == 3)
    splits = [[list(f), list(t), sorted(set(range(10)) - set(f) - set(t))] for f in combinations(range(10), 4) for t in combinations(sorted(set(range(10)) - set(f)), 3)]
    assert (again(now.values()), small(now.values())) == min((again(s), small(s)) for s in splits)


def test_sizes_of_tables(spark):
    rows = [(n, p, p) for n in (1, 2, 3, 5, 6, 7, 13) for p in range(n)]
    now = tables(pairing.pods(spark.createDataFrame(rows, "contest int, player int, rank int")).collect())
    size = {n: sorted(len(v) for (c, _), v in now.items() if c == n) for n in (1, 2, 3, 5, 6, 7, 13)}
    assert size == {1: [], 2: [], 3: [3], 5: [5], 6: [3, 3], 7: [3, 4], 13: [3, 3, 3, 4]}
