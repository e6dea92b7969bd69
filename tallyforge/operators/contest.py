"""Contests: standings, opponents, brackets, round robins and pairings, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .rank import numbered

FLOOR = 1 / 3


def sides(matches: DataFrame) -> DataFrame:
    """One row for each player of each match (contest, round, a, b, wins_a, wins_b, draws); b is null in a bye.

    A bye counts as won 2-0 and has no opponent.
    """
    bye = F.col("b").isNull()
    won, lost = F.when(bye, 2).otherwise(F.col("wins_a")), F.when(bye, 0).otherwise(F.col("wins_b"))
    drawn = F.when(bye, 0).otherwise(F.col("draws"))
    first = F.struct(F.col("a").alias("player"), F.col("b").alias("opponent"), won.alias("won"), lost.alias("lost"), drawn.alias("drawn"))
    second = F.struct(F.col("b").alias("player"), F.col("a").alias("opponent"), lost.alias("won"), won.alias("lost"), drawn.alias("drawn"))
    return matches.select("contest", "round", F.explode(F.array_compact(F.array(first, F.when(~bye, second)))).alias("x")).select("contest", "round", "x.*")


def stats(rows: DataFrame, win: float = 3, draw: float = 1, loss: float = 0) -> DataFrame:
    """Points and rates of each player; rates have a floor of a third, and are that floor without games."""
    result = F.when(F.col("won") > F.col("lost"), win).when(F.col("won") == F.col("lost"), draw).otherwise(loss)
    s = rows.groupBy("contest", "player").agg(
        F.count(F.lit(1)).alias("rounds"), F.sum(result).alias("points"), F.count_if(F.col("opponent").isNull()).alias("byes"),
        F.sum("won").alias("games_won"), F.sum("lost").alias("games_lost"), F.sum("drawn").alias("games_drawn"),
    )
    games = F.col("games_won") + F.col("games_lost") + F.col("games_drawn")
    rate = lambda got, most: F.greatest(F.lit(FLOOR), F.when(most > 0, got / most).otherwise(0.0))
    return s.withColumn("match_rate", rate(F.col("points"), F.col("rounds") * win)).withColumn("game_rate", rate(F.col("games_won") * 3 + F.col("games_drawn"), games * 3))


def standings(matches: DataFrame, upto: int | None = None) -> DataFrame:
    """Players in order: points, opponents' match rate, own game rate, opponents' game rate, then the player.

    Each meeting counts in the opponents' means; rates are rounded to nine decimals before they are compared, so that
    equal fractions tie. ``upto`` gives the table after that round.
    """
    rows = sides(matches if upto is None else matches.where(F.col("round") <= upto))
    s = stats(rows)
    rates = s.select("contest", F.col("player").alias("opponent"), F.col("match_rate").alias("r1"), F.col("game_rate").alias("r2"))
    met = rows.where("opponent is not null").join(rates, ["contest", "opponent"]).groupBy("contest", "player").agg(F.avg("r1").alias("omw"), F.avg("r2").alias("ogw"))
    out = s.join(met, ["contest", "player"], "left").fillna(0.0, ["omw", "ogw"])
    order = [F.desc("points"), F.desc(F.round("omw", 9)), F.desc(F.round("game_rate", 9)), F.desc(F.round("ogw", 9)), F.col("player")]
    return numbered(out, ["contest"], order, "rank")


def pod_standings(pods: DataFrame, size: int = 4, win: float = 7, draw: float = 1) -> DataFrame:
    """Standings of tables of several players (contest, round, pod, players, winner or null for a draw).

    Opponents' match rates have the floor 1 / ``win``; a table short of ``size`` players counts ghosts at the floor.
    """
    floor = 1 / win
    seats = pods.select("contest", "round", "pod", "winner", "players", F.explode("players").alias("player"))
    points = F.when(F.col("winner").isNull(), draw).when(F.col("winner") == F.col("player"), win).otherwise(0.0)
    s = seats.groupBy("contest", "player").agg(F.count(F.lit(1)).alias("rounds"), F.sum(points).alias("points"), F.sum(size - F.size("players")).alias("ghosts"))
    s = s.withColumn("match_rate", F.greatest(F.lit(floor), F.col("points") / (F.col("rounds") * win)))
    met = seats.select("contest", "player", F.explode("players").alias("opponent")).where("player <> opponent")
    them = s.select("contest", F.col("player").alias("opponent"), F.col("points").alias("their_points"), F.col("match_rate").alias("their_rate"))
    mean = met.join(them, ["contest", "opponent"]).groupBy("contest", "player").agg(F.avg("their_points").alias("opponent_points"), F.sum("their_rate").alias("sum_rate"), F.count(F.lit(1)).alias("n"))
    out = s.join(mean, ["contest", "player"], "left").fillna(0.0, ["opponent_points", "sum_rate"]).fillna(0, ["n"])
    out = out.withColumn("omw", F.coalesce((F.col("sum_rate") + F.col("ghosts") * floor) / F.nullif(F.col("n") + F.col("ghosts"), F.lit(0)), F.lit(0.0)))
    order = [F.desc("points"), F.desc(F.round("match_rate", 9)), F.desc(F.round("opponent_points", 9)), F.desc(F.round("omw", 9)), F.col("player")]
    return numbered(out, ["contest"], order, "rank").drop("sum_rate", "n")


def meetings(rows: DataFrame) -> DataFrame:
    """How often each pair has met (a before b)."""
    return rows.where("opponent is not null and player < opponent").groupBy("contest", F.col("player").alias("a"), F.col("opponent").alias("b")).agg(F.count(F.lit(1)).alias("met"))


def round_robin(players: DataFrame) -> DataFrame:
    """Circle method (players: contest, seat from 0): every pair once; with an odd number, b is null once for each.

    Pairs are computed from seat arithmetic, one row for each seat and round, without a join of players with players.
    """
    n = Window.partitionBy("contest")
    p = players.withColumn("size", F.count(F.lit(1)).over(n)).withColumn("even", F.col("size") + F.col("size") % 2)
    rows = p.select("contest", "seat", "size", "even", F.explode(F.sequence(F.lit(0), F.col("even") - 2)).alias("round"))
    circle, last = F.col("even") - 1, F.col("even") - 1
    facing = F.pmod(2 * F.col("round") - F.col("seat"), circle)
    other = F.when(F.col("seat") == last, F.col("round")).when(facing == F.col("seat"), last).otherwise(facing)
    rows = rows.withColumn("other", other)
    real = F.col("other") < F.col("size")
    return rows.where(~real | (F.col("seat") < F.col("other"))).select("contest", (F.col("round") + 1).cast("int").alias("round"), F.col("seat").cast("long").alias("a"), F.when(real, F.col("other")).cast("long").alias("b"))


def bracket_size(n: Column) -> Column:
    return F.pow(F.lit(2), F.ceil(F.log2(F.greatest(n, F.lit(1))))).cast("int")


def seed_order(size: int) -> list[int]:
    """Seeds in the order of their slots: each doubling faces seed s with size + 1 - s."""
    out = [1]
    while len(out) < size:
        out = [x for s in out for x in (s, 2 * len(out) + 1 - s)]
    return out


def bracket_rounds(seeds: DataFrame, results: DataFrame, size: int) -> DataFrame:
    """All slots of an elimination bracket (contest, phase, slot, a, b, winner); byes advance at once.

    ``seeds`` has contest, seed and player; ``results`` contest, phase, slot and winner. A result whose winner is not in
    its slot is stale and does not count. One join for each of the log2(size) phases.
    """
    spark = seeds.sparkSession
    slots = spark.createDataFrame([(s, i // 2, i % 2) for i, s in enumerate(seed_order(size))], "seed int, slot int, side int")
    now = seeds.join(F.broadcast(slots), "seed").groupBy("contest", "slot").agg(F.max(F.when(F.col("side") == 0, F.col("player"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("player"))).alias("b"))
    out, phase = None, 0
    while size > 1:
        told = results.where(F.col("phase") == phase).select("contest", "slot", F.col("winner").alias("told"))
        now = now.join(told, ["contest", "slot"], "left")
        bye = F.when(F.col("b").isNull(), F.col("a")).when(F.col("a").isNull(), F.col("b")) if phase == 0 else F.lit(None).cast(now.schema["a"].dataType)
        winner = F.coalesce(bye, F.when(F.col("told").isin(F.col("a"), F.col("b")), F.col("told")))
        now = now.withColumn("winner", winner).withColumn("stale", F.col("told").isNotNull() & ~F.col("told").eqNullSafe(winner))
        part = now.select("contest", F.lit(phase).alias("phase"), "slot", "a", "b", "winner", "stale")
        out = part if out is None else out.unionByName(part)
        now = now.groupBy("contest", F.floor(F.col("slot") / 2).cast("int").alias("next")).agg(F.max(F.when(F.col("slot") % 2 == 0, F.col("winner"))).alias("a"), F.max(F.when(F.col("slot") % 2 == 1, F.col("winner"))).alias("b")).withColumnRenamed("next", "slot")
        size, phase = size // 2, phase + 1
    return out


def placing(bracket: DataFrame) -> DataFrame:
    """Place of every player of a bracket: by the phase they lost in; equal phases share a place."""
    final = bracket.groupBy("contest").agg(F.max("phase").alias("last"))
    lost = bracket.join(final, "contest").where("winner is not null").select("contest", "phase", "last", F.explode(F.array_compact(F.array("a", "b"))).alias("player"), "winner")
    best = lost.groupBy("contest", "player").agg(F.max(F.when((F.col("player") == F.col("winner")) & (F.col("phase") == F.col("last")), F.col("phase") + 1).otherwise(F.col("phase"))).alias("reached"))
    return best.withColumn("place", F.rank().over(Window.partitionBy("contest").orderBy(F.desc("reached"))))


def suggested_rounds(n: Column, cut: Column | None = None) -> Column:
    """Rounds for n players; a cut to four or fewer of 9 to 16 players asks for five."""
    rounds = F.when(n < 2, 0).when(n <= 128, F.ceil(F.log2(n)).cast("int")).when(n <= 226, 8).when(n <= 409, 9).otherwise(10)
    return rounds if cut is None else F.when((cut <= 4) & n.between(9, 16), 5).otherwise(rounds)


def suggested_pod_rounds(n: Column) -> Column:
    return F.when(n < 3, 0).when(n <= 12, 3).when(n <= 24, 4).otherwise(5)


def bracket_slots(seeds: DataFrame) -> DataFrame:
    """Every slot of each contest's bracket (contest, size, slot, seed, player); player is null in a slot without a seed.

    ``seeds`` has contest, seed (from 1, without gaps) and player. A slot's seed follows from its bits, from the highest:
    in a bracket twice as large a seed keeps the even one of its two slots and faces its mirror in the odd one.
    """
    sizes = seeds.groupBy("contest").agg(bracket_size(F.max("seed")).alias("size"))
    slots = sizes.select("contest", "size", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("slot"))
    depth = F.round(F.log2("size")).cast("int")
    rounds = F.filter(F.sequence(F.lit(0), depth), lambda i: i > 0)
    half = lambda i: F.floor(F.col("slot") / F.pow(F.lit(2), depth - i)) % 2
    seed = F.aggregate(rounds, F.lit(1).cast("long"), lambda s, i: F.when(half(i) == 0, s).otherwise(F.pow(F.lit(2), i).cast("long") + 1 - s))
    players = seeds.select("contest", F.col("seed").cast("long").alias("seed"), "player")
    return slots.withColumn("seed", seed).join(players, ["contest", "seed"], "left").select("contest", "size", "slot", "seed", "player")


def pod_sizes(n: Column) -> Column:
    """Sizes of the tables of n players: fours, then threes; five players sit together, fewer than three nowhere."""
    tables = F.ceil(n / 4).cast("int")
    threes = tables * 4 - n
    whole = F.concat(F.array_repeat(F.lit(4), F.greatest(tables - threes, F.lit(0)).cast("int")), F.array_repeat(F.lit(3), F.greatest(threes, F.lit(0)).cast("int")))
    return F.when(n < 3, F.array().cast("array<int>")).when(n == 5, F.array(F.lit(5))).otherwise(whole)


def valid_score(best_of: Column, a: Column, b: Column, draws: Column) -> Column:
    """Scores possible in a match of best of one or three."""
    need = F.when(best_of == 1, 1).otherwise(2)
    whole = (a >= 0) & (b >= 0) & (draws >= 0) & (a <= need) & (b <= need)
    return whole & ~((a == need) & (b == need)) & (a + b + draws <= F.when(best_of == 1, 1).otherwise(5)) & (a + b + draws > 0)


def minutes_left(started: Column, paused: Column, resumed: Column, now: Column, limit: Column) -> Column:
    """Minutes of a round's clock that are left; a pause does not count, and time over is negative."""
    stop = F.coalesce(F.when(resumed.isNull(), paused), now)
    pause = F.when(resumed.isNotNull(), resumed - paused).otherwise(0)
    return limit - (stop - started - pause)


def seat_frame(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.lit(0).alias("contest"), F.col("id").cast("int").alias("seat"))
