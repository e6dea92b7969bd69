"""Pairs and tables of the next round at least cost: exchanges that lower the cost, all contests at once.

A cost is compared part by part: meetings so far, then squared gaps in points, then a tie break. Every few pairs (or tables)
that stand near each other look for their best exchange, and those that are the best offer to all they touch are made,
until there is none (``exchanges.py``, inside tasks). A contest of up to ``PLACES`` players is one block of a task's rows; a
larger one is cut into blocks of so many places, and again with the cuts half a block on, until neither changes anything.
What a player knows of past rounds travels as a map from opponent to meetings, which is as long as the rounds played.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import columns_of
from .exchanges import MOST_MET, by_groups, exchanged_pairs, traded_seats
from .rank import numbered
from .tables import dealt, written

#: Points that the place of a bye lies below the last player, at least.
BYE_GAP = 3
#: Contests are improved from several starts at once.
START = ["contest", "way"]
#: Places of a block.
PLACES = 512
#: Rows that a task takes at once, about.
ROWS = 1024


def agreed(offers: DataFrame, keys: list[str], ends: str) -> DataFrame:
    """Rows of ``offers`` (keys, offer, an array of ends) whose offer is the smallest of each of its ends."""
    best = offers.select(*keys, "offer", F.explode(ends).alias("end")).groupBy(*keys, "end").agg(F.min("offer").alias("offer"))
    won = best.groupBy(*keys, "offer").agg(F.count(F.lit(1)).alias("__n"))
    return offers.join(won, [*keys, "offer"]).where(F.col("__n") == F.size(ends)).drop("__n")


def _met_maps(met: DataFrame, number: DataFrame, name: str = "met") -> DataFrame:
    """(contest, r, met): for each player's number, a map from opponents' numbers to meetings, for both of a pair."""
    of = lambda x: number.select("contest", F.col("player").alias(x), F.col("r").alias(f"r{x}"))
    rows = met.select("contest", "a", "b", "met").join(of("a"), ["contest", "a"]).join(of("b"), ["contest", "b"]).where("ra <> rb")
    both = rows.select("contest", F.explode(F.array(F.struct("ra", "rb"), F.struct(F.col("rb").alias("ra"), F.col("ra").alias("rb")))).alias("x"), "met")
    each = both.groupBy("contest", F.col("x.ra").alias("r"), F.col("x.rb").alias("other")).agg(F.sum("met").alias("met"))
    return each.groupBy("contest", "r").agg(F.map_from_entries(F.collect_list(F.struct("other", F.col("met").cast("long")))).alias(name))


def _times(u: Column, v: Column) -> Column:
    return F.coalesce(F.try_element_at(u["met"], v["r"]), F.lit(0).cast("long"))


# --------------------------------------------------------------------------- pairs


def _settled(rows: DataFrame, place: str, size: Column, wide: int, run, extra: str = "") -> DataFrame:
    """``rows`` (contest, way, ``place``, ...) after ``run`` of every block, until no cut of larger contests changes anything.

    ``size`` is the places of a row's contest, ``wide`` those of a block; half a block holds whatever may be exchanged.
    """
    columns = rows.columns

    def turn(df: DataFrame, shift: int) -> DataFrame:
        large = size > wide
        cut = df.select(*columns, large.alias("large"), F.when(large, F.floor((F.col(place) + shift) / wide)).otherwise(0).cast("long").alias("block"))
        schema = f"{columns_of(cut, cut.columns)}, {extra}moved boolean"
        keys = [*START, "block"]
        ordered = dealt(cut, *keys).sortWithinPartitions(*keys, place)
        return written(ordered.mapInArrow(by_groups(keys, ROWS, run), schema))

    out = turn(rows, 0)
    done, large, shift = out.where("not large"), out.where("large"), 0
    while not large.isEmpty():
        shift = wide // 2 - shift
        large = turn(large, shift)
        if large.where("moved").isEmpty():
            break
    return done.unionByName(large)


def swiss_pairs(players: DataFrame, met: DataFrame, near: int = 8, final: bool = False, ways: int = 4) -> DataFrame:
    """Pairs for the next round (contest, a, b, met, gap): few rematches, then small squared gaps in points.

    ``players`` has contest, player, rank and, if known, points and byes; ``met`` contest, a, b and met. With an odd
    number, a place of ``BYE_GAP`` points below the last is paired too, and who gets it has a bye (b is null); an earlier
    bye counts as a meeting with it. Players are first paired in order of points, equal ones drawn, in ``ways`` draws;
    then two or three pairs that stand near each other exchange partners while that lowers the cost, and each contest's
    cheapest start goes on with four; so up to eight players are paired as cheaply as can be. In a ``final`` round
    nearness in rank decides instead of the draw. One player alone has a bye. What ``met`` says of others is ignored.
    """
    points, byes = (F.coalesce(F.col(c), F.lit(0)) if c in players.columns else F.lit(0) for c in ("points", "byes"))
    rows = players.select("contest", "player", "rank", points.cast("double").alias("points"), byes.cast("long").alias("byes"))
    rows = written(numbered(rows, ["contest"], [F.desc("points"), F.col("rank"), F.col("player")], "r"))
    sizes = rows.groupBy("contest").agg(F.count(F.lit(1)).cast("int").alias("n"), F.min("points").alias("least"))
    odd = sizes.where("n % 2 = 1")
    known = rows.join(_met_maps(met, rows), ["contest", "r"], "left").join(sizes.select("contest", "n", F.when(F.col("n") % 2 == 1, F.col("n") + 1).alias("bye")), "contest", "left")
    none = F.create_map().cast("map<int,bigint>")
    had = F.when(F.col("bye").isNotNull() & (F.col("byes") > 0), F.create_map("bye", "byes")).otherwise(none)
    known = known.select("contest", "r", "player", "points", F.col("rank").cast("long").alias("rank"), F.map_concat(F.coalesce("met", none), had).alias("met"), "n")
    last = F.col("n") + 1
    free = odd.select("contest", last.alias("r"), F.lit(None).cast(rows.schema["player"].dataType).alias("player"), (F.col("least") - BYE_GAP).alias("points"), last.cast("long").alias("rank"), none.alias("met"), "n")
    seats = known.unionByName(free).select("contest", F.struct("r", "player", "points", "rank", "met", "n").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(0 if final else ways - 1))).alias("way"))
    drawn = F.when(F.col("way") > 0, F.xxhash64("contest", "p.r", "way")).otherwise(0)
    seats = numbered(seats, START, [F.desc("p.points"), drawn, F.col("p.r")], "place")
    pairs = seats.groupBy(*START, F.ceil(F.col("place") / 2).alias("pair")).agg(F.min_by("p", "place").alias("u"), F.max_by("p", "place").alias("v"))
    u, v = F.col("u"), F.col("v")
    x, y = F.when(u["r"] < v["r"], u).otherwise(v), F.when(u["r"] < v["r"], v).otherwise(u)  # x stands before y
    improved = lambda df, most: _settled(df, "k", F.col("x.n"), max(PLACES, 4 * near + 2), exchanged_pairs(most, 2 * near, final), "cost long, ")
    pairs = improved(pairs.select(*START, x["r"].alias("k"), x.alias("x"), y.alias("y")), 3)
    total = pairs.groupBy(*START).agg(F.sum(F.col("cost").cast("decimal(20,0)")).alias("cost"))
    best = total.groupBy("contest").agg(F.min_by("way", F.struct("cost", "way")).alias("way"))
    pairs = improved(pairs.join(best, START, "left_semi").select(*START, "k", "x", "y"), 4)
    x, y = F.col("x"), F.col("y")
    return pairs.select("contest", x["player"].alias("a"), y["player"].alias("b"), _times(x, y).alias("met"), ((x["points"] - y["points"]) ** 2).alias("gap"))


def first_pairs(players: DataFrame, seed: int) -> DataFrame:
    """The drawn first round (contest, a, b): players in the order of the MD5 of ``seed/player``, an odd last one has a bye."""
    rows = players.select("contest", "player", F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("player").cast("string")).cast("binary")).alias("h"))
    rows = numbered(rows, ["contest"], [F.col("h"), F.col("player")], "r")
    return rows.groupBy("contest", F.ceil(F.col("r") / 2).alias("pair")).agg(F.min_by("player", "r").alias("a"), F.max(F.when(F.col("r") % 2 == 0, F.col("player"))).alias("b")).select("contest", "a", "b")


# --------------------------------------------------------------------------- tables

def deal_cost(seats: DataFrame) -> DataFrame:
    """(contest, way, cost): pairs that meet again, the most often met first; seats of small tables taken again; gaps."""
    u, v = F.col("p"), F.col("q")
    two = seats.join(seats.select(*START, "pod", F.col("p").alias("q")), [*START, "pod"]).where(u["r"] < v["r"])
    pairs = two.groupBy(*START).agg(
        F.array(*[F.count_if(F.least(_times(u, v), F.lit(MOST_MET)) == m) for m in range(MOST_MET, 0, -1)]).alias("again"), F.sum((u["points"] - v["points"]) ** 2).alias("gap"),
    )
    small = seats.groupBy(*START).agg(F.sum(F.when(F.col("pod") >= F.col("p.full"), F.col("p.small")).otherwise(0)).alias("small"))
    return pairs.join(small, START).select(*START, F.struct("again", "small", "gap").alias("cost"))


def pods(players: DataFrame, met: DataFrame | None = None, ways: int = 4, near: int = 8) -> DataFrame:
    """Tables of four and three (contest, pod, player): few meet again, few sit at a small table again, points are near.

    ``players`` has contest, player, rank and, if known, points and small (times at a table below the usual size);
    ``met`` contest, a, b and met; without it the round is drawn. A contest of five has one table, one of fewer than
    three none. Deals start by points and by ``ways`` - 1 drawn orders; tables within ``near`` of each other trade two
    players while that lowers the cost, and each contest keeps its cheapest deal. Table 0 has the most points.
    """
    points, small = (F.coalesce(F.col(c), F.lit(0)) if c in players.columns else F.lit(0) for c in ("points", "small"))
    rows = players.select("contest", "player", "rank", points.cast("double").alias("points"), small.cast("long").alias("small"))
    rows = written(numbered(rows, ["contest"], [F.desc("points"), F.col("rank"), F.col("player")], "r"))
    n = F.col("n")
    tables = F.when(n == 5, 1).otherwise(F.ceil(n / 4)).cast("int")
    full = F.when(n == 5, 1).when(n % 4 == 0, tables).otherwise(tables - (tables * 4 - n)).cast("int")
    sizes = rows.groupBy("contest").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("contest", "n", tables.alias("tables"), full.alias("four"))
    none = F.create_map().cast("map<int,bigint>")
    known = rows.join(_met_maps(met, rows), ["contest", "r"], "left") if met is not None else rows.withColumn("met", none)
    # tables of three are the usual size where there are no others
    usual = F.when(F.col("four") > 0, F.col("four")).otherwise(F.col("tables"))
    seat = F.struct("contest", "r", "player", "points", "small", F.coalesce("met", none).alias("met"), usual.alias("full"))
    seated = known.join(sizes, "contest").select("contest", F.col("n"), "tables", "four", seat.alias("p"))
    first = 1 if met is None else 0
    seated = seated.withColumn("way", F.explode(F.sequence(F.lit(first), F.lit(first if met is None else ways - 1))))
    seated = numbered(seated, ["contest", "way"], [F.when(F.col("way") > 0, F.xxhash64("contest", "p.r", "way")).otherwise(0), F.col("p.r")], "place")
    fours = 4 * F.col("four")
    pod = F.when(n == 5, 0).when(F.col("place") <= fours, F.floor((F.col("place") - 1) / 4)).otherwise(F.col("four") + F.floor((F.col("place") - 1 - fours) / 3))
    seats = written(seated.select("contest", "way", "tables", "p", pod.cast("int").alias("pod")))
    if met is not None:
        seats = _settled(seats, "pod", F.col("tables"), max(PLACES // 4, 2 * near + 2), traded_seats(near))
        best = deal_cost(seats).groupBy("contest").agg(F.min_by("way", F.struct("cost", "way")).alias("way"))
        seats = seats.join(best, ["contest", "way"], "left_semi")
    order = seats.groupBy("contest", "pod").agg(F.avg("p.points").alias("mean"), F.min("p.r").alias("first"))
    order = numbered(order, ["contest"], [F.desc("mean"), F.col("first")], "at").select("contest", "pod", (F.col("at") - 1).alias("at"))
    return seats.join(order, ["contest", "pod"]).select("contest", F.col("at").alias("pod"), "p.player")
