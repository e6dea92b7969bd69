"""Exchanges that lower the cost of pairs and tables, made in numpy for many contests of one task at once.

Rows come sorted by contest, start and block. In each round every few pairs (or two tables) that stand near each other
offer their best exchange, and those that are the best offer to all they touch are made; contests without an offer are
done. What two players cost each other stands in one matrix a contest, filled once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Offers valued at once.
AT_ONCE = 1 << 16


def by_groups(keys: list[str], most: int, run: Callable[[pa.Table, np.ndarray], pa.Table]):
    """For mapInArrow over sorted rows: ``run`` of whole groups, some ``most`` rows at once, with each row's group number."""

    def groups(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        for k in keys:
            c = t.column(k).combine_chunks()
            new[1:] |= pc.fill_null(pc.not_equal(c[1:], c[:-1]), True).to_numpy(zero_copy_only=False)
        return np.cumsum(new)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = pa.concat_tables([*([held] if held is not None else []), pa.Table.from_batches([batch])])
            if held.num_rows < most:
                continue
            g = groups(held)
            first = np.flatnonzero(np.diff(g, prepend=-1))
            at = 0
            for nxt in (*first[1:], None):  # the last group may go on in the next batch
                if nxt is None or nxt - at >= most:
                    end = first[-1] if nxt is None else nxt
                    if end > at:
                        yield from run(held.slice(at, end - at).combine_chunks(), g[at:end] - g[at]).to_batches()
                    at = end
            held = held.slice(at)
        if held is not None and held.num_rows:
            yield from run(held.combine_chunks(), groups(held)).to_batches()

    return go


class Seats:
    """Players of several contests, numbered so that a contest's stand together, and a matrix for each contest."""

    def __init__(self, group: np.ndarray, r: np.ndarray) -> None:
        self.group, self.r = group, r
        self.first = np.flatnonzero(np.diff(group, prepend=-1))
        size = np.diff(np.r_[self.first, len(group)])
        self.start, self.size = self.first[group], size[group]
        at = np.r_[0, np.cumsum(size**2)]
        self.row, self.place = at[group] + (np.arange(len(group)) - self.start) * self.size, np.arange(len(group)) - self.start

    def all_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Both seats of each place of the matrices, in order."""
        s = np.repeat(np.arange(len(self.r)), self.size)
        return s, np.arange(len(s)) - self.row[s] + self.start[s]

    def at(self, s: np.ndarray, t: np.ndarray) -> np.ndarray:
        return self.row[s] + self.place[t]

    def known(self, owner: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the (owner seat, number of another player) have both here, and the other's seat."""
        wide = int(max(self.r.max(initial=0), other.max(initial=0))) + 1
        key, want = self.group * wide + self.r, self.group[owner] * wide + other
        order = np.argsort(key)
        t = order[np.minimum(np.searchsorted(key, want, sorter=order), len(key) - 1)]
        here = np.flatnonzero(key[t] == want)
        return here, t[here]


def _meetings(seats: Seats, met: pa.MapArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seat, other's seat, times) of all that have met, from each seat's map from players' numbers to times."""
    offsets = met.offsets.to_numpy()
    owner = np.repeat(np.arange(len(met)), np.diff(offsets))
    part = slice(offsets[0], offsets[-1])
    other, times = (x.to_numpy(zero_copy_only=False)[part].astype(np.int64) for x in (met.keys, met.items))
    here, t = seats.known(owner, other)
    return owner[here], t, times[here]


def _field(rows: pa.StructArray, name: str) -> np.ndarray:
    return rows.field(name).to_numpy(zero_copy_only=False)


def _with(rows: pa.Table, **columns: pa.Array) -> pa.Table:
    for name, values in columns.items():
        at = rows.schema.get_field_index(name)
        rows = rows.append_column(name, values) if at < 0 else rows.set_column(at, name, values)
    return rows


def _agreed(value: tuple[np.ndarray, ...], ends: np.ndarray, n: int) -> np.ndarray:
    """Which offers are the smallest (by ``value``, then by ends, which are columns padded by -1) of each of their ends."""
    order = np.lexsort((*ends.T[::-1], *value[::-1]))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    best = np.full(n + 1, len(order))  # the last place is for padding
    for e in ends.T:
        np.minimum.at(best, e, rank)
    best[n] = -1
    return np.flatnonzero(((best[ends] == rank[:, None]) | (ends < 0)).all(axis=1))


# --------------------------------------------------------------------------- pairs

#: Bits of a cost below meetings, and below gaps in points (squared, in sixteenths) in a last round.
MET_BITS, GAP_BITS, MOST_TIMES = 42, 20, 255
_AS = 128


def _matchings(labels: list[int]) -> list[list[tuple[int, int]]]:
    if not labels:
        return [[]]
    first, rest = labels[0], labels[1:]
    return [[(first, x), *m] for i, x in enumerate(rest) for m in _matchings(rest[:i] + rest[i + 1 :])]


def _exchanges(size: int) -> list[list[tuple[int, int]]]:
    """All ways to pair the players of ``size`` pairs (2 i, 2 i + 1) in which no pair stays."""
    return [m for m in _matchings(list(range(2 * size))) if not any(a % 2 == 0 and b == a + 1 for a, b in m)]


_WAYS = [*_exchanges(2), *_exchanges(3), *_exchanges(4)]


def pair_costs(seats: Seats, players: pa.StructArray, final: bool) -> np.ndarray:
    """Meetings (or byes), then the squared gap in points and, in a last round, the gap in ranks, as one number."""
    s, t = seats.all_pairs()
    points, rank = _field(players, "points"), _field(players, "rank")
    most = (1 << (MET_BITS - (GAP_BITS if final else 0))) - 1
    cost = np.minimum(np.floor((points[s] - points[t]) ** 2 * 16 + 0.5), most).astype(np.int64)
    if final:
        cost = (cost << GAP_BITS) + np.minimum(np.abs(rank[s] - rank[t]), (1 << GAP_BITS) - 1)
    s, t, times = _meetings(seats, players.field("met"))
    lower = seats.r[s] < seats.r[t]
    s, t, times = s[lower], t[lower], np.minimum(times[lower], MOST_TIMES) << MET_BITS
    cost[seats.at(s, t)] += times
    cost[seats.at(t, s)] += times
    return cost


def _near_sets(pos: np.ndarray, wide: int, size: int) -> np.ndarray:
    """All sets of ``size`` rows, as columns of places in the sorted ``pos``, within ``wide`` of each other."""
    end = np.searchsorted(pos, pos + wide, side="right")
    sets = np.arange(len(pos))[:, None]
    for _ in range(size - 1):
        more = end[sets[:, 0]] - 1 - sets[:, -1]
        last = np.repeat(sets[:, -1], more) + 1 + np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
        sets = np.c_[np.repeat(sets, more, axis=0), last]
    return sets


def _offers(seats: Seats, cost: np.ndarray, x: np.ndarray, y: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the sets of pairs (x, y) those that gain by an exchange, and gain and number of the best one together."""
    size, keep, found = sets.shape[1], [], []
    ways = [(i, way) for i, way in enumerate(_WAYS) if len(way) == size]
    for at in range(0, len(sets), AT_ONCE):
        part = sets[at : at + AT_ONCE]
        who = [side[part[:, i]] for i in range(size) for side in (x, y)]
        between = {(a, b): cost[seats.at(who[a], who[b])] for b in range(2 * size) for a in range(b)}
        old = sum(between[2 * i, 2 * i + 1] for i in range(size))
        best = np.full(len(part), np.iinfo(np.int64).max)
        for i, way in ways:
            np.minimum(best, (sum(between[ab] for ab in way) - old) * _AS + i, out=best)
        some = np.flatnonzero(best < 0)
        keep.append(part[some])
        found.append(best[some])
    return (np.concatenate(keep), np.concatenate(found)) if keep else (sets[:0], np.zeros(0, np.int64))


def exchanged_pairs(most: int, wide: int, final: bool):
    """Pairs (x, y and others) that no exchange among ``most`` pairs within ``wide`` places makes cheaper; with cost and moved."""

    def run(rows: pa.Table, group: np.ndarray) -> pa.Table:
        n = rows.num_rows
        both = [rows.column(c).combine_chunks() for c in ("x", "y")]
        turn = np.arange(2 * n).reshape(2, n).T.ravel()
        players = pa.concat_arrays(both).take(pa.array(turn))
        r = _field(players, "r").astype(np.int64)
        seats = Seats(np.repeat(group, 2), r)
        cost = pair_costs(seats, players, final)
        x, y, moved = np.arange(0, 2 * n, 2), np.arange(1, 2 * n, 2), np.zeros(group[-1] + 1, bool)
        live = np.ones(group[-1] + 1, bool)
        apart = int(r.max()) + wide + 1
        while live.any():
            here = np.flatnonzero(live[group])
            here = here[np.lexsort((r[x[here]], group[here]))]
            pos = group[here] * apart + r[x[here]]
            offers = [_offers(seats, cost, x[here], y[here], _near_sets(pos, wide, size)) for size in range(2, most + 1)]
            ends = np.concatenate([np.pad(e, ((0, 0), (0, most - e.shape[1])), constant_values=-1) for e, _ in offers])
            best = np.concatenate([b for _, b in offers])
            live = np.zeros_like(live)
            live[group[here[ends[:, 0]]]] = True
            moved |= live
            taken = _agreed((best,), ends, len(here))
            way = best[taken] & (_AS - 1)
            for w in np.unique(way):
                at = here[ends[taken[way == w], : len(_WAYS[w])]]
                who = np.stack([x[at], y[at]], axis=2).reshape(len(at), -1)
                for i, (a, b) in enumerate(_WAYS[w]):
                    u, v = who[:, a], who[:, b]
                    first = r[u] < r[v]
                    x[at[:, i]], y[at[:, i]] = np.where(first, u, v), np.where(first, v, u)
        return _with(rows, x=players.take(pa.array(x)), y=players.take(pa.array(y)), k=pa.array(r[x], rows.schema.field("k").type), cost=pa.array(cost[seats.at(x, y)]), moved=pa.array(moved[group]))

    return run


# --------------------------------------------------------------------------- tables

#: Times two players have met beyond which more do not weigh more.
MOST_MET = 7


def traded_seats(near: int):
    """Seats (p, pod and others) after trades of two players of tables within ``near`` while that lowers the cost; with moved."""

    def run(rows: pa.Table, group: np.ndarray) -> pa.Table:
        players = rows.column("p").combine_chunks()
        pod = rows.column("pod").to_numpy().astype(np.int64)
        r, points, small, full = (_field(players, c) for c in ("r", "points", "small", "full"))
        r = r.astype(np.int64)
        seats = Seats(group, r)
        s, t = seats.all_pairs()
        gap = (points[s] - points[t]) ** 2
        # one more meeting of those who met oftener outweighs all others of a trade
        again = np.zeros(len(s), np.int64)
        a, b, times = _meetings(seats, players.field("met"))
        again[seats.at(a, b)] = np.where(times > 0, 32 ** (np.clip(times, 1, MOST_MET) - 1), 0)
        apart = int(pod.max()) + near + 1
        moved, live = np.zeros(group[-1] + 1, bool), np.ones(group[-1] + 1, bool)
        at = group * apart + pod  # tables keep their number of seats
        tables, number = np.unique(at, return_inverse=True)
        of = group[np.unique(number, return_index=True)[1]]
        first = np.searchsorted(of, np.arange(group[-1] + 1))
        count = np.bincount(of)
        base = np.cumsum(count[group]) - count[group] - first[group]  # a seat's row of what it would add to each table
        while live.any():
            on = live[group[s]]
            i, j = s[on], t[on]
            add = lambda w: np.bincount(base[i] + number[j], w[on], count[group].sum())  # noqa: E731, B023
            adds_again, adds_gap = add(again), add(gap)
            lower = (at[i] < at[j]) & (at[j] <= at[i] + near)
            i, j, w, g = i[lower], j[lower], again[on][lower], gap[on][lower]
            change = lambda adds: adds[base[i] + number[j]] - adds[base[i] + number[i]] + adds[base[j] + number[i]] - adds[base[j] + number[j]]  # noqa: E731, B023
            again_by = np.round(change(adds_again)).astype(np.int64) - 2 * w
            gap_by = np.round(change(adds_gap) - 2 * g, 6) + 0.0
            # tables of the usual size come first, so only the later of two can be the smaller one
            small_by = ((pod[j] >= full[i]).astype(np.int64) - (pod[i] >= full[i])) * (small[i] - small[j])
            some = np.flatnonzero((again_by < 0) | ((again_by == 0) & ((small_by < 0) | ((small_by == 0) & (gap_by < 0)))))
            i, j = i[some], j[some]
            live = np.zeros_like(live)
            live[group[i]] = True
            moved |= live
            taken = _agreed((again_by[some], small_by[some], gap_by[some], r[i], r[j]), np.c_[number[i], number[j]], len(tables))
            i, j = i[taken], j[taken]
            for x in (pod, at, number):
                x[i], x[j] = x[j], x[i]
        return _with(rows, pod=pa.array(pod, rows.schema.field("pod").type), moved=pa.array(moved[group]))

    return run
