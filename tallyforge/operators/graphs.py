"""Graph work across captures: spatial overlaps, suppression and spanning forests, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import settled, written


def overlaps(a: DataFrame, b: DataFrame, group: list[str], cell: float, least: float = 0.55) -> DataFrame:
    """Pairs of boxes (id, left, top, right, bottom) of a group whose intersection over union reaches ``least``.

    Boxes meet through the grid cells they cover, so only boxes of a common cell are compared; a pair that shares
    several cells counts once, in the cell of the larger left and top edge.
    """
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    cut = lambda df: df.withColumn("cx", F.explode(span("left", "right"))).withColumn("cy", F.explode(span("top", "bottom")))
    x, y = cut(a).alias("x"), cut(b).alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in [*group, "cx", "cy"]]
    on = same[0]
    for s in same[1:]:
        on = on & s
    e = lambda f, c: f(F.col(f"x.{c}"), F.col(f"y.{c}"))
    both = F.greatest(F.lit(0.0), e(F.least, "right") - e(F.greatest, "left")) * F.greatest(F.lit(0.0), e(F.least, "bottom") - e(F.greatest, "top"))
    size = lambda t: (F.col(f"{t}.right") - F.col(f"{t}.left")) * (F.col(f"{t}.bottom") - F.col(f"{t}.top"))
    here = (F.floor(e(F.greatest, "left") / cell) == F.col("x.cx")) & (F.floor(e(F.greatest, "top") / cell) == F.col("x.cy"))
    rows = x.join(y, on).where(here).withColumn("iou", both / (size("x") + size("y") - both))
    return rows.where(F.col("iou") >= least).select(*[F.col(f"x.{c}") for c in group], F.col("x.id").alias("a"), F.col("y.id").alias("b"), "iou")


def suppressed(boxes: DataFrame, pairs: DataFrame, group: list[str]) -> DataFrame:
    """Greedy non-maximum suppression: the best-scored box of every overlap stays and removes those it overlaps.

    Each round keeps every box that beats all its live neighbours; rounds end when no overlap is left.
    """
    live = settled(boxes)
    links = pairs.select(*group, "a", "b").unionByName(pairs.select(*group, F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    kept = None
    while True:
        mine = live.select(*group, F.col("id").alias("a"), F.struct((-F.col("score")).alias("s"), F.col("id")).alias("me"))
        them = live.select(*group, F.col("id").alias("b"), F.struct((-F.col("score")).alias("s"), F.col("id")).alias("other"))
        met = links.join(mine, [*group, "a"]).join(them, [*group, "b"])
        beaten = met.groupBy(*group, "a").agg(F.min("other").alias("best"), F.first("me").alias("me")).where("best < me").select(*group, F.col("a").alias("id"))
        won = settled(live.join(beaten, [*group, "id"], "left_anti"))
        kept = won if kept is None else kept.unionByName(won)
        gone = links.join(won.select(*group, F.col("id").alias("a")), [*group, "a"]).select(*group, F.col("b").alias("id")).unionByName(won.select(*group, "id")).distinct()
        live = settled(live.join(gone, [*group, "id"], "left_anti"))
        if live.isEmpty():
            return kept


def suppressed_in_cells(boxes: DataFrame, group: list[str], cell: float, least: float = 0.55, first: int = 2000) -> DataFrame:
    """Greedy non-maximum suppression of boxes (group, id, left, top, right, bottom, score) that overlap by ``least``.

    What the best-scored boxes come to does not depend on worse ones. So about ``first`` of the best are settled among
    themselves, those that they remove go, and four times as many of what is left follow, until none is left. Kept boxes
    hardly overlap, so few of them stand in a cell, and the pairs among all boxes are never made.
    """
    live, kept, size = settled(boxes), None, first
    while True:
        cut = []
        if live.count() > size:
            n = live.count()
            cut = live.where(~F.isnan("score")).approxQuantile("score", [max(0.0, 1 - size / n)], 0.001)
        best = (F.col("score").isNull() | ((F.col("score") >= cut[0]) & ~F.isnan("score"))) if cut else F.lit(True)
        top = settled(live.where(best))
        won = settled(suppressed(top, overlaps(top, top, group, cell, least).where("a < b"), group))
        kept = won if kept is None else kept.unionByName(won)
        rest = live.where(~best)
        gone = overlaps(rest, won, group, cell, least).select(*group, F.col("a").alias("id")).distinct()
        live = settled(rest.join(gone, [*group, "id"], "left_anti"))
        if live.isEmpty():
            return kept
        size *= 4


def spanning_forest(edges: DataFrame) -> DataFrame:
    """A maximum spanning forest of (a, b, weight) by rounds of heaviest edges (Boruvka); ties go to the smaller ends.

    Each round every component takes its heaviest outgoing edge, components along taken edges merge, and the number of
    components at least halves.
    """
    rows = settled(edges.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("weight").alias("weight")))
    label = settled(rows.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("part")))
    taken = None
    while True:
        of = lambda c: label.select(F.col("node").alias(c), F.col("part").alias(f"p{c}"))
        across = rows.join(of("a"), "a").join(of("b"), "b").where("pa <> pb").withColumn("edge", F.struct((-F.col("weight")).alias("w"), "a", "b", "pa", "pb"))
        best = across.select(F.explode(F.array("pa", "pb")).alias("part"), "edge").groupBy("part").agg(F.min("edge").alias("edge"))
        best = settled(best.select("part", "edge.*"))
        if best.isEmpty():
            return taken if taken is not None else rows.where("false")
        new = best.select("a", "b", (-F.col("w")).alias("weight"), "pa", "pb").distinct()
        part = new.select("a", "b", "weight")
        taken = part if taken is None else taken.unionByName(part)
        # parts hang under the part their best edge leads to; of two that choose each other the smaller is the root
        up = best.select("part", F.when(F.col("part") == F.col("pa"), F.col("pb")).otherwise(F.col("pa")).alias("to"))
        back = up.select(F.col("part").alias("to"), F.col("to").alias("back"))
        up = settled(up.join(back, "to", "left").select("part", F.when((F.col("back") == F.col("part")) & (F.col("part") < F.col("to")), F.col("part")).otherwise(F.col("to")).alias("to")))
        while True:
            jump = up.alias("u").join(up.alias("v"), F.col("u.to") == F.col("v.part")).select("u.part", F.col("v.to").alias("to"), (F.col("u.to") != F.col("v.to")).alias("moved"))
            jump = settled(jump)
            up = jump.select("part", "to")
            if jump.where("moved").isEmpty():
                break
        label = settled(label.join(up, "part", "left").select("node", F.coalesce("to", "part").alias("part")))


def replayed(commands: DataFrame, size: int = 4096) -> DataFrame:
    """Replays score commands per contest (contest, seq, kind, player, amount): the state is a score a player.

    ``add`` changes, ``undo`` takes back the last change that still stands, ``drop`` closes a player; changes of closed
    players do not count. Undone changes are found by the running balance of changes and undos. Sums and minima run within
    chunks of ``size`` numbers and over the chunks' totals, so that a long log is split; seq is a number.
    """
    shut = commands.where("kind = 'drop'").groupBy("contest", "player").agg(F.min("seq").alias("closed"))
    rows = commands.where("kind <> 'drop'").join(shut, ["contest", "player"], "left").where((F.col("kind") != "add") | F.col("closed").isNull() | (F.col("seq") < F.col("closed")))
    rows = rows.select("contest", "seq", "kind", "player", "amount", F.floor(F.col("seq") / size).alias("chunk"))
    order = Window.partitionBy("contest", "chunk").orderBy("seq")
    # undos without a change to undo do not count: lift the balance by its lowest point so far
    rows = rows.withColumn("depth", F.sum(F.when(F.col("kind") == "add", 1).otherwise(-1)).over(order)).withColumn("low", F.min("depth").over(order))
    rows = written(rows)
    along = Window.partitionBy("contest").orderBy("chunk")
    before, later = along.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("contest").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy("contest", "chunk").agg(F.max_by("depth", "seq").alias("total"), F.min("low").alias("least"))
    chunks = chunks.withColumn("start", F.coalesce(F.sum("total").over(before), F.lit(0)))
    chunks = chunks.withColumn("floor", F.least(F.lit(0), F.coalesce(F.min(F.col("start") + F.col("least")).over(before), F.lit(0)))).select("contest", "chunk", "start", "floor")
    height = F.col("start") + F.col("depth") - F.least("floor", F.col("start") + F.col("low"))
    rows = written(rows.join(chunks, ["contest", "chunk"]).select("contest", "chunk", "seq", "kind", "player", "amount", height.alias("height")))
    ends = rows.groupBy("contest", "chunk").agg(F.min("height").alias("least")).select("contest", "chunk", F.min("least").over(later).alias("later"))
    # the least height of all later rows, by running minima from the end
    after = Window.partitionBy("contest", "chunk").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("after", F.min("height").over(after)).join(ends, ["contest", "chunk"])
    stands = (F.col("kind") == "add") & (F.coalesce(F.least("after", "later"), F.lit(1 << 30)) >= F.col("height"))
    return rows.where(stands).groupBy("contest", "player").agg(F.sum("amount").alias("score"), F.count(F.lit(1)).alias("changes"))
