from __future__ import annotations

import random

from tallyforge.operators.command_log import PHASE_MOVES, PHASES, STATES, THING_MOVES, replayed_log

SCHEMA = "contest int, seq long, kind string, name string"


def one_by_one(rows, phase=None, states=None):
    """The same, a command after the other."""
    phase, states, counts = dict(phase or {}), dict(states or {}), {}
    for contest, _, kind, name in sorted(rows, key=lambda r: r[:2]):
        if kind in THING_MOVES:
            what, moves, phases = THING_MOVES[kind]
            key = (contest, what, name if what != "clock" else "")
            new = moves[states.get(key, 0)] if phase.get(contest, 0) in phases else -1
            states[key] = states.get(key, 0) if new < 0 else new
        else:
            key = (contest, "contest", "")
            new = PHASE_MOVES.get(kind, [-1] * 5)[phase.get(contest, 0)]
            phase[contest] = phase.get(contest, 0) if new < 0 else new
        counts.setdefault(key, [0, 0])[new < 0] += 1
    return {k: (PHASES[phase[k[0]]] if k[1] == "contest" else STATES[k[1]][states[k]], *n) for k, n in counts.items()}, phase, states


def planted(n, seed=3):
    r = random.Random(seed)
    kinds = [*THING_MOVES, *PHASE_MOVES, "rename"]
    return [(r.choice([1, 1, 1, 2]), i, r.choice(kinds), r.choice("xyz")) for i in range(n)]


def told(df):
    return {(r.contest, r.thing, r.name): (r.state, r.applied, r.refused) for r in df.collect()}


def test_chunks_equal_one_by_one(spark):
    assert len(PHASE_MOVES) + len(THING_MOVES) == 16
    rows = planted(600)
    want = one_by_one(rows)[0]
    assert told(replayed_log(spark.createDataFrame(rows, SCHEMA), size=8)) == want  # four levels of chunks
    assert told(replayed_log(spark.createDataFrame(rows + rows[:50], SCHEMA))) == want  # repeated rows are one command


def test_goes_on_from_a_snapshot(spark):
    rows = planted(200, 5)
    early, late = [r for r in rows if r[1] < 120], [r for r in rows if r[1] >= 120]
    _, phase, states = one_by_one(early)
    snapshot = replayed_log(spark.createDataFrame(early, SCHEMA), size=16)
    assert told(replayed_log(spark.createDataFrame(late, SCHEMA), snapshot, size=16)) == one_by_one(late, phase, states)[0]


def test_nulls_and_no_rows(spark):
    rows = [(1, None, "start", None), (None, 1, "start", None), (1, 1, None, "x"), (1, 2, "add", None), (1, 3, "start", None)]
    assert told(replayed_log(spark.createDataFrame(rows, SCHEMA))) == {(1, "contest", ""): ("running", 1, 0)}
    assert replayed_log(spark.createDataFrame([], SCHEMA)).count() == 0
