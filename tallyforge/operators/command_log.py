"""Replay of contest logs: every command is a step on a few states, so chunks of a log compose before their start is known.

A contest is in a phase; its players, matches and clock have states of their own. What a command does depends on the phase
and on the state of the thing it names, and on nothing else, so phases are found first and things after, each by a fold
over chunks: a chunk's steps are composed to one, those of many chunks likewise, and states go back down. No log passes
through one task, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written

#: Sequence numbers of a chunk.
SIZE = 512
PHASES = ("open", "running", "playoff", "finished", "finished after playoff")
NO = -1
#: What a command makes of each phase.
PHASE_MOVES = {
    "start": [1, NO, NO, NO, NO], "unstart": [NO, 0, NO, NO, NO], "cut": [NO, 2, NO, NO, NO], "uncut": [NO, NO, 1, NO, NO],
    "finish": [NO, 3, 4, NO, NO], "reopen": [NO, NO, NO, 1, 2],
}
STATES = {"player": ("absent", "in", "dropped"), "match": ("none", "set", "none"), "clock": ("idle", "going", "paused")}
#: What a command makes of the three states of its thing, the kind of thing, and the phases that allow it.
THING_MOVES = {
    "add": ("player", [1, NO, NO], (0, 1)), "remove": ("player", [NO, 0, NO], (0,)), "drop": ("player", [NO, 2, NO], (1, 2)), "undrop": ("player", [NO, NO, 1], (1, 2)),
    "result": ("match", [1, 1, NO], (1, 2)), "clear": ("match", [NO, 0, NO], (1, 2)),
    "go": ("clock", [1, NO, NO], (1, 2)), "pause": ("clock", [NO, 2, NO], (1, 2)), "resume": ("clock", [NO, NO, 1], (1, 2)), "reset": ("clock", [NO, 0, 0], (0, 1, 2)),
}


def _ints(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def states_before(rows: DataFrame, keys: list[str], width: int, starts: DataFrame | None = None, size: int = SIZE) -> DataFrame:
    """``rows`` (keys, seq, other columns, moves) with ``before``, the state of its key before each row.

    ``moves`` gives the next state for each of ``width`` states, or -1 where the row is not allowed and changes nothing.
    A key starts in its ``start`` of ``starts``, or in 0. Rows of a key are in order of seq, then of their other columns.
    """
    rest = [c for c in rows.columns if c not in [*keys, "seq"]]
    chunked = rows.groupBy(*keys, F.floor(F.col("seq") / size).cast("long").alias("chunk"))
    lists = written(chunked.agg(F.array_sort(F.collect_list(F.struct("seq", *rest))).alias("list")))
    after = lambda x, state: F.when(x["moves"][state] < 0, state).otherwise(x["moves"][state])
    low, high = lists.agg(F.min("chunk"), F.max("chunk")).first()
    if low == high:
        heads = lists.select(*keys, "chunk")
        heads = heads.join(starts.select(*keys, "start"), keys, "left") if starts is not None else heads.withColumn("start", F.lit(0))
        heads = heads.select(*keys, "chunk", F.coalesce(F.col("start").cast("int"), F.lit(0)).alias("before"))
    else:
        whole = F.aggregate("list", _ints(range(width)), lambda at, x: F.transform(at, lambda s: after(x, s)))
        up = lists.select(*keys, F.col("chunk").alias("seq"), whole.alias("moves"))
        heads = states_before(up, keys, width, starts, size).select(*keys, F.col("seq").alias("chunk"), "before")
    first = F.struct(F.col("before").alias("state"), F.array().cast("array<int>").alias("seen"))
    run = F.aggregate("list", first, lambda at, x: F.struct(after(x, at["state"]).alias("state"), F.concat(at["seen"], F.array(at["state"])).alias("seen")), lambda at: at["seen"])
    told = lists.join(heads, [*keys, "chunk"]).select(*keys, F.explode(F.arrays_zip(F.col("list").alias("x"), run.alias("before"))).alias("z"))
    return told.select(*keys, "z.x.*", "z.before")


def _moves(kind: Column, table: dict[str, list[int]], default: list[int]) -> Column:
    out = _ints(default)
    for name, moves in table.items():
        out = F.when(kind == name, _ints(moves)).otherwise(out)
    return out


def replayed_log(commands: DataFrame, snapshot: DataFrame | None = None, size: int = SIZE) -> DataFrame:
    """State of each contest and of all it names after its log: contest, thing, name, state, applied, refused.

    ``commands`` has contest, seq (a number, one command each), kind and name (a player or match; ignored for phases and
    the clock). Commands that are not allowed where they come change nothing and count as refused; kinds that are not
    known count as refused of the contest. ``snapshot``, rows of an earlier result, is where a log of later commands goes
    on from; counts are those of this log, and what it does not touch is not in the result. Repeated rows are one command.
    Rows without contest, seq or kind, and commands on players or matches without a name, take no part.
    """
    thing = F.lit("contest")
    for kind, (what, _, _) in THING_MOVES.items():
        thing = F.when(F.col("kind") == kind, what).otherwise(thing)
    rows = commands.select("contest", F.col("seq").cast("long").alias("seq"), "kind", F.col("name").cast("string").alias("name")).where("contest is not null and seq is not null and kind is not null")
    rows = rows.withColumn("thing", thing).withColumn("name", F.when(F.col("thing").isin("player", "match"), F.col("name")).otherwise("")).where("name is not null").distinct()
    starts = things = None
    if snapshot is not None:
        at = F.when(F.col("thing") == "contest", F.array_position(F.array(*map(F.lit, PHASES)), F.col("state")))
        for what, names in STATES.items():
            at = at.when(F.col("thing") == what, F.array_position(F.array(*map(F.lit, names)), F.col("state")))
        held = snapshot.select("contest", "thing", "name", (at - 1).cast("int").alias("start"))
        starts, things = held.where("thing = 'contest'").select("contest", "start"), held.where("thing <> 'contest'")
    still = list(range(len(PHASES)))
    idle = {k: still for k in THING_MOVES}
    phased = written(states_before(rows.withColumn("moves", _moves(F.col("kind"), PHASE_MOVES | idle, [NO] * len(PHASES))), ["contest"], len(PHASES), starts, size))
    allowed = F.lit(False)
    for kind, (_, _, phases) in THING_MOVES.items():
        allowed = F.when(F.col("kind") == kind, F.col("before").isin(*phases)).otherwise(allowed)
    acts = phased.where("thing <> 'contest'").withColumn("moves", F.when(allowed, _moves(F.col("kind"), {k: m for k, (_, m, _) in THING_MOVES.items()}, [NO] * 3)).otherwise(_ints([NO] * 3)))
    done = states_before(acts.select("contest", "thing", "name", "seq", "kind", "moves"), ["contest", "thing", "name"], 3, things, size)
    both = done.unionByName(phased.where("thing = 'contest'").select(*done.columns))
    fits = F.col("moves")[F.col("before")] >= 0
    after = F.when(fits, F.col("moves")[F.col("before")]).otherwise(F.col("before"))
    last = both.groupBy("contest", "thing", "name").agg(F.max_by(after, F.struct("seq", "kind")).alias("at"), F.count_if(fits).alias("applied"), F.count_if(~fits).alias("refused"))
    text = F.when(F.col("thing") == "contest", F.array(*map(F.lit, PHASES))[F.col("at")])
    for what, names in STATES.items():
        text = text.when(F.col("thing") == what, F.array(*map(F.lit, names))[F.col("at")])
    return last.select("contest", "thing", "name", text.alias("state"), "applied", "refused")
