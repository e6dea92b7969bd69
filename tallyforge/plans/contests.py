"""Contest queries. An order is a match of two customers; nations and suppliers are players."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.command_log import replayed_log
from ..operators.contest import bracket_rounds, bracket_size, bracket_slots, meetings, minutes_left, placing, pod_sizes, pod_standings, round_robin, sides, standings, suggested_pod_rounds, suggested_rounds, valid_score
from ..operators.pairing import first_pairs, pods, swiss_pairs
from .registry import Tables, query

MATCHES = """
WITH m AS (
  SELECT o_orderkey // 200 AS contest, o_orderkey % 7 + 1 AS round, o_custkey % 40 AS a,
    CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE (o_custkey % 40 + 1 + o_orderkey % 11) % 40 END AS b,
    CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN o_orderkey % 3 ELSE 1 END AS wa,
    CASE o_orderstatus WHEN 'F' THEN o_orderkey % 2 WHEN 'O' THEN 2 ELSE 1 END AS wb, o_orderkey % 2 AS dr
  FROM orders
), s AS (
  SELECT contest, round, a AS player, b AS opponent, CASE WHEN b IS NULL THEN 2 ELSE wa END AS won, CASE WHEN b IS NULL THEN 0 ELSE wb END AS lost, CASE WHEN b IS NULL THEN 0 ELSE dr END AS drawn FROM m
  UNION ALL SELECT contest, round, b, a, wb, wa, dr FROM m WHERE b IS NOT NULL
), t AS (
  SELECT contest, player, count(*) AS rounds, CAST(sum(CASE WHEN won > lost THEN 3 WHEN won = lost THEN 1 ELSE 0 END) AS BIGINT) AS points, count(*) FILTER (WHERE opponent IS NULL) AS byes,
    CAST(sum(won) AS BIGINT) AS gw, CAST(sum(lost) AS BIGINT) AS gl, CAST(sum(drawn) AS BIGINT) AS gd FROM s GROUP BY 1, 2
), r AS (
  SELECT *, greatest(1 / 3, points / (rounds * 3.0)) AS mr, greatest(1 / 3, CASE WHEN gw + gl + gd > 0 THEN (gw * 3 + gd) / ((gw + gl + gd) * 3.0) ELSE 0 END) AS gr FROM t
), o AS (
  SELECT s.contest, s.player, avg(mr) AS omw, avg(gr) AS ogw FROM s JOIN r ON r.contest = s.contest AND r.player = s.opponent GROUP BY 1, 2
), z AS (
  SELECT r.*, coalesce(omw, 0) AS omw, coalesce(ogw, 0) AS ogw FROM r LEFT JOIN o USING (contest, player)
), x AS (
  SELECT *, row_number() OVER (PARTITION BY contest ORDER BY points DESC, round(omw, 9) DESC, round(gr, 9) DESC, round(ogw, 9) DESC, player) AS rank FROM z
)
"""


def matches(t: Tables) -> DataFrame:
    k, me = F.col("o_orderkey"), F.col("o_custkey") % 40
    status = F.col("o_orderstatus")
    return t.orders.select(
        F.floor(k / 200).alias("contest"), (k % 7 + 1).alias("round"), me.alias("a"), F.when(k % 23 != 0, (me + 1 + k % 11) % 40).alias("b"),
        F.when(status == "F", 2).when(status == "O", k % 3).otherwise(1).alias("wins_a"), F.when(status == "F", k % 2).when(status == "O", 2).otherwise(1).alias("wins_b"), (k % 2).alias("draws"),
    )


@query(MATCHES + """
SELECT contest, player, points, byes, gw AS games_won, gl AS games_lost, gd AS games_drawn, round(omw, 6) AS omw, round(gr, 6) AS game_rate, round(ogw, 6) AS ogw, rank FROM x
""")
def standings_duel(t: Tables) -> DataFrame:
    s = standings(matches(t))
    return s.select("contest", "player", F.col("points").cast("long").alias("points"), "byes", "games_won", "games_lost", "games_drawn", F.round("omw", 6).alias("omw"), F.round("game_rate", 6).alias("game_rate"), F.round("ogw", 6).alias("ogw"), F.col("rank").cast("long").alias("rank"))


@query(MATCHES.replace("FROM orders\n", "FROM orders WHERE o_orderkey % 7 + 1 <= 3\n") + "SELECT contest, player, rank FROM x")
def standings_upto(t: Tables) -> DataFrame:
    """The table as it stood after the third round."""
    return standings(matches(t), upto=3).select("contest", "player", F.col("rank").cast("long").alias("rank"))


@query(MATCHES + "SELECT contest, player AS a, opponent AS b, count(*) AS met FROM s WHERE player < opponent GROUP BY 1, 2, 3")
def head_to_head(t: Tables) -> DataFrame:
    return meetings(sides(matches(t)))


@query(MATCHES + """
, h AS (SELECT contest, player AS a, opponent AS b, count(*) AS met FROM s WHERE player < opponent GROUP BY 1, 2, 3)
SELECT contest, count(*) FILTER (WHERE met > 1) AS pairs, CAST(max(met) AS BIGINT) AS worst FROM h GROUP BY 1
""")
def rematch_summary(t: Tables) -> DataFrame:
    return meetings(sides(matches(t))).groupBy("contest").agg(F.count_if(F.col("met") > 1).alias("pairs"), F.max("met").alias("worst"))


@query(MATCHES + "SELECT contest, player, rank, row_number() OVER (PARTITION BY contest ORDER BY rank) AS seed FROM x WHERE player % 9 <> 0 QUALIFY seed <= 8")
def cut_topx(t: Tables) -> DataFrame:
    """The best eight who have not left."""
    s = standings(matches(t)).where("player % 9 <> 0")
    w = Window.partitionBy("contest").orderBy("rank")
    return s.withColumn("seed", F.row_number().over(w).cast("long")).where("seed <= 8").select("contest", "player", F.col("rank").cast("long").alias("rank"), "seed")


@query(MATCHES + """
, q AS (SELECT contest, player, points, round(omw, 9) AS o, rank() OVER (PARTITION BY contest ORDER BY points DESC, round(omw, 9) DESC) AS k FROM x)
SELECT contest, count(*) FILTER (WHERE k = 1) AS leaders, CAST(max(points) AS BIGINT) AS points FROM q GROUP BY 1
""")
def leaders(t: Tables) -> DataFrame:
    s = standings(matches(t))
    k = F.rank().over(Window.partitionBy("contest").orderBy(F.desc("points"), F.desc(F.round("omw", 9))))
    return s.withColumn("k", k).groupBy("contest").agg(F.count_if(F.col("k") == 1).alias("leaders"), F.max("points").cast("long").alias("points"))


PODS = """
WITH e AS (SELECT DISTINCT user_id AS player, hour(ts) AS round, day(ts) AS contest FROM events),
n AS (SELECT *, (row_number() OVER (PARTITION BY contest, round ORDER BY player) - 1) // 4 AS pod FROM e),
p AS (SELECT contest, round, pod, list(player ORDER BY player) AS players FROM n GROUP BY 1, 2, 3),
g AS (SELECT *, CASE WHEN (round + pod) % 4 = 0 THEN NULL ELSE players[(round + pod) % len(players) + 1] END AS winner FROM p),
s AS (SELECT contest, round, pod, winner, len(players) AS size, unnest(players) AS player FROM g),
t AS (SELECT contest, player, count(*) AS rounds, sum(CASE WHEN winner IS NULL THEN 1.0 WHEN winner = player THEN 7 ELSE 0 END) AS points, sum(4 - size) AS ghosts FROM s GROUP BY 1, 2),
r AS (SELECT *, greatest(1 / 7, points / (rounds * 7)) AS mr FROM t),
o AS (SELECT a.contest, a.player, avg(r.points) AS op, sum(r.mr) AS sr, count(*) AS n FROM s a JOIN s b ON a.contest = b.contest AND a.round = b.round AND a.pod = b.pod AND a.player <> b.player JOIN r ON r.contest = b.contest AND r.player = b.player GROUP BY 1, 2),
z AS (SELECT r.*, coalesce(op, 0) AS op, coalesce((coalesce(sr, 0) + ghosts / 7) / nullif(coalesce(n, 0) + ghosts, 0), 0) AS omw FROM r LEFT JOIN o USING (contest, player))
"""


@query(PODS + """
SELECT contest, player, CAST(points AS DOUBLE) AS points, round(mr, 6) AS match_rate, round(op, 6) AS opponent_points, round(omw, 6) AS omw,
  row_number() OVER (PARTITION BY contest ORDER BY points DESC, round(mr, 9) DESC, round(op, 9) DESC, round(omw, 9) DESC, player) AS rank FROM z
""")
def standings_pods(t: Tables) -> DataFrame:
    """A day's users as players, its hours as rounds, each with tables of four for everyone who is there."""
    seats = t.events.select(F.col("user_id").alias("player"), F.hour("ts").alias("round"), F.dayofmonth("ts").alias("contest")).distinct()
    seats = seats.withColumn("pod", F.floor((F.row_number().over(Window.partitionBy("contest", "round").orderBy("player")) - 1) / 4).cast("int"))
    tables = seats.groupBy("contest", "round", "pod").agg(F.sort_array(F.collect_list("player")).alias("players"))
    at = (F.col("round") + F.col("pod")) % F.size("players") + 1
    tables = tables.withColumn("winner", F.when((F.col("round") + F.col("pod")) % 4 != 0, F.element_at("players", at)))
    s = pod_standings(tables)
    return s.select("contest", "player", "points", F.round("match_rate", 6).alias("match_rate"), F.round("opponent_points", 6).alias("opponent_points"), F.round("omw", 6).alias("omw"), F.col("rank").cast("long").alias("rank"))


@query("""
WITH p AS (SELECT n_regionkey AS contest, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS seat FROM nation),
n AS (SELECT contest, count(*) AS size FROM p GROUP BY 1)
SELECT a.contest, count(*) AS pairs FROM p a JOIN p b ON a.contest = b.contest AND a.seat < b.seat GROUP BY 1
""")
def round_robin_pairs(t: Tables) -> DataFrame:
    seats = t.nation.withColumn("seat", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1).select(F.col("n_regionkey").alias("contest"), "seat")
    return round_robin(seats).where("b is not null").groupBy("contest").agg(F.countDistinct(F.least("a", "b"), F.greatest("a", "b")).alias("pairs"))


@query("""
WITH RECURSIVE p AS (SELECT s_nationkey AS contest, s_suppkey AS player, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS seed FROM supplier),
n AS (SELECT contest, count(*) AS n FROM p GROUP BY 1),
s(size, seeds) AS (SELECT 1, [1] UNION ALL SELECT size * 2, flatten(list_transform(seeds, lambda x: [x, size * 2 + 1 - x])) FROM s WHERE size < (SELECT max(n) FROM n)),
z AS (SELECT contest, size, unnest(range(size)) AS slot, unnest(seeds) AS seed FROM n JOIN s ON size >= n AND size < 2 * n)
SELECT contest, size, slot, seed, player FROM z LEFT JOIN p USING (contest, seed)
""")
def bracket_seed(t: Tables) -> DataFrame:
    """The brackets of each nation's suppliers, seeded by balance."""
    seed = F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey"))
    return bracket_slots(t.supplier.select(F.col("s_nationkey").alias("contest"), F.col("s_suppkey").alias("player"), seed.alias("seed"))).withColumn("slot", F.col("slot").cast("long"))


@query("""
WITH c AS (SELECT o_custkey AS contest, count(*) AS players, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS cut FROM orders GROUP BY 1)
SELECT contest, players, CAST(pow(2, ceil(log2(players))) AS INTEGER) AS size,
  CASE WHEN cut <= 4 AND players BETWEEN 9 AND 16 THEN 5 WHEN players < 2 THEN 0 ELSE CAST(ceil(log2(players)) AS INTEGER) END AS rounds, CASE WHEN players < 3 THEN 0 WHEN players <= 12 THEN 3 WHEN players <= 24 THEN 4 ELSE 5 END AS pod_rounds,
  CASE WHEN players < 3 THEN '' WHEN players = 5 THEN '5' ELSE rtrim(repeat('4,', CAST(ceil(players / 4) - (ceil(players / 4) * 4 - players) AS INTEGER)) || repeat('3,', CAST(ceil(players / 4) * 4 - players AS INTEGER)), ',') END AS pods
FROM c
""")
def contest_sizes(t: Tables) -> DataFrame:
    """Brackets, rounds and tables for contests as large as each customer's number of orders, with a cut of its finished ones."""
    c = t.orders.groupBy(F.col("o_custkey").alias("contest")).agg(F.count(F.lit(1)).alias("players"), F.count_if(F.col("o_orderstatus") == "F").alias("cut"))
    n = F.col("players").cast("int")
    return c.select("contest", "players", bracket_size(n).alias("size"), suggested_rounds(n, F.col("cut")).alias("rounds"), suggested_pod_rounds(n).alias("pod_rounds"), F.array_join(pod_sizes(n), ",").alias("pods"))


@query("""
WITH s AS (SELECT n_regionkey AS contest, n_nationkey AS player, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS seed FROM nation),
f AS (SELECT a.contest, a.player AS p1, d.player AS p4, b.player AS p2, c.player AS p3 FROM s a JOIN s d ON d.contest = a.contest AND d.seed = 4 JOIN s b ON b.contest = a.contest AND b.seed = 2 JOIN s c ON c.contest = a.contest AND c.seed = 3 WHERE a.seed = 1)
SELECT contest, unnest([p1, p2, p3, p4]) AS player, unnest([1, 2, 3, 3]) AS place FROM f
""")
def elimination_places(t: Tables) -> DataFrame:
    """Four seeds of each region; the better seed always wins, and the losers of a phase share a place."""
    seeds = t.nation.withColumn("seed", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))).where("seed <= 4").select(F.col("n_regionkey").alias("contest"), "seed", F.col("n_nationkey").alias("player"))
    by = lambda seed, phase, slot: seeds.where(F.col("seed") == seed).select("contest", F.lit(phase).alias("phase"), F.lit(slot).alias("slot"), F.col("player").alias("winner"))
    results = by(1, 0, 0).unionByName(by(2, 0, 1)).unionByName(by(1, 1, 0))
    return placing(bracket_rounds(seeds, results, 4)).select("contest", "player", F.col("place").cast("int").alias("place"))


@query("""
WITH m AS (SELECT o_orderkey AS id, 1 + 2 * (o_orderkey % 2) AS best, o_orderkey % 4 AS a, o_custkey % 3 AS b, o_orderkey % 3 AS d FROM orders)
SELECT best AS best_of, count(*) AS n, count(*) FILTER (WHERE a <= need AND b <= need AND NOT (a = need AND b = need) AND a + b + d <= CASE best WHEN 1 THEN 1 ELSE 5 END AND a + b + d > 0) AS valid
FROM (SELECT *, CASE best WHEN 1 THEN 1 ELSE 2 END AS need FROM m) GROUP BY 1
""")
def score_validity(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    rows = t.orders.select((1 + 2 * (k % 2)).alias("best_of"), (k % 4).alias("a"), (F.col("o_custkey") % 3).alias("b"), (k % 3).alias("d"))
    return rows.groupBy("best_of").agg(F.count(F.lit(1)).alias("n"), F.count_if(valid_score(F.col("best_of"), F.col("a"), F.col("b"), F.col("d"))).alias("valid"))


@query("""
SELECT o_orderkey AS id, 50 - (CASE WHEN o_orderkey % 3 = 1 THEN 10 ELSE 20 + o_orderkey % 40 END - (CASE WHEN o_orderkey % 3 = 2 THEN 5 ELSE 0 END)) AS left_ FROM orders
""")
def clock_left(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    paused, resumed = F.when(k % 3 > 0, 10), F.when(k % 3 == 2, 15)
    return t.orders.select(k.alias("id"), minutes_left(F.lit(0), paused, resumed, 20 + k % 40, F.lit(50)).alias("left_"))


@query("""
WITH m AS (SELECT o_orderkey AS id, o_orderkey // 200 AS contest, least(o_custkey % 40, o_custkey // 40) AS best, CASE WHEN o_orderkey % 23 = 0 THEN 1 ELSE 0 END AS bye FROM orders)
SELECT contest, id, row_number() OVER (PARTITION BY contest ORDER BY bye, best, id) AS table_no FROM m
""")
def table_numbers(t: Tables) -> DataFrame:
    """Tables by the better rank of the pair, byes last."""
    rows = t.orders.select(F.floor(F.col("o_orderkey") / 200).alias("contest"), F.col("o_orderkey").alias("id"), F.least(F.col("o_custkey") % 40, F.floor(F.col("o_custkey") / 40)).alias("best"), (F.col("o_orderkey") % 23 == 0).alias("bye"))
    return rows.select("contest", "id", F.row_number().over(Window.partitionBy("contest").orderBy("bye", "best", "id")).cast("long").alias("table_no"))


@query()
def swiss_pairing(t: Tables) -> DataFrame:
    """The next round of every contest."""
    m = matches(t)
    return swiss_pairs(standings(m), meetings(sides(m))).select("contest", "a", "b")


@query("""
WITH RECURSIVE o AS (SELECT o_custkey AS a, o_custkey // 8 * 8 + (o_custkey % 8 + 1 + o_orderkey % 7) % 8 AS b, CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'P' THEN 1 ELSE 0 END AS p FROM orders WHERE o_orderpriority = '1-URGENT'),
c AS (SELECT c_custkey AS player, c_custkey // 8 AS contest FROM customer),
k AS (SELECT contest, player, row_number() OVER (PARTITION BY contest ORDER BY player) - 1 AS i, CAST(coalesce(sum(p), 0) AS BIGINT) AS points FROM c LEFT JOIN o ON a = player GROUP BY 1, 2),
n AS (SELECT contest, count(*) AS n, min(points) - 3 AS low FROM k GROUP BY 1),
v AS (SELECT contest, player, i, points FROM k UNION ALL SELECT contest, NULL, n, low FROM n WHERE n % 2 = 1),
m AS (SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS met FROM o GROUP BY 1, 2),
e AS (SELECT x.contest, x.i, y.i AS j, coalesce(met, 0) AS met, (x.points - y.points) ** 2 AS gap FROM v x JOIN v y ON x.contest = y.contest AND x.i < y.i LEFT JOIN m ON m.a = least(x.player, y.player) AND m.b = greatest(x.player, y.player)),
w(contest, used, met, gap) AS (
  SELECT contest, 0::BIGINT, 0::BIGINT, 0::DOUBLE FROM n
  UNION ALL
  SELECT w.contest, w.used | (1::BIGINT << e.i) | (1::BIGINT << e.j), w.met + e.met, w.gap + e.gap FROM w JOIN e ON e.contest = w.contest AND (w.used & ((1::BIGINT << (e.i + 1)) - 1)) = (1::BIGINT << e.i) - 1 AND (w.used >> e.j) & 1 = 0
)
SELECT w.contest, CAST(min(w.met * 1e9 + w.gap) // 1e9 AS BIGINT) AS met, min(w.met * 1e9 + w.gap) % 1e9 AS gap FROM w JOIN n USING (contest) WHERE w.used = (1::BIGINT << (n.n + n.n % 2)) - 1 GROUP BY 1
""")
def swiss_cost(t: Tables) -> DataFrame:
    """What the next round costs in contests of eight customers, whose urgent orders were matches: as little as any pairing of them."""
    k, me = F.col("o_orderkey"), F.col("o_custkey")
    one, two = F.floor(me / 8), F.floor(me / 8) * 8 + (me % 8 + 1 + k % 7) % 8
    played = t.orders.where("o_orderpriority = '1-URGENT'").select(one.alias("contest"), me.alias("a"), two.alias("b"), F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "P", 1).otherwise(0).alias("p"))
    points = played.groupBy(F.col("a").alias("player")).agg(F.sum("p").alias("points"))
    players = t.customer.select(F.floor(F.col("c_custkey") / 8).alias("contest"), F.col("c_custkey").alias("player")).join(points, "player", "left").withColumn("rank", F.col("player"))
    met = played.groupBy("contest", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("met"))
    return swiss_pairs(players, met).groupBy("contest").agg(F.sum("met").alias("met"), F.sum("gap").alias("gap"))


@query("""
WITH d AS (SELECT s_nationkey AS contest, s_suppkey AS player, row_number() OVER (PARTITION BY s_nationkey ORDER BY md5('11/' || s_suppkey), s_suppkey) AS k FROM supplier)
SELECT x.contest, x.player AS a, y.player AS b FROM d x LEFT JOIN d y ON x.contest = y.contest AND y.k = x.k + 1 WHERE x.k % 2 = 1
""")
def first_round(t: Tables) -> DataFrame:
    """The drawn first round of each nation's suppliers."""
    return first_pairs(t.supplier.select(F.col("s_nationkey").alias("contest"), F.col("s_suppkey").alias("player")), 11)


@query()
def pod_pairing(t: Tables) -> DataFrame:
    """The next tables of every contest."""
    m = matches(t)
    return pods(standings(m), meetings(sides(m)))


@query("""
WITH RECURSIVE c AS (
  SELECT user_id % 40 AS contest, event_id AS seq, k, CASE WHEN k IN ('add', 'remove', 'drop', 'undrop') THEN CAST(user_id // 40 % 3 AS VARCHAR) WHEN k IN ('result', 'clear') THEN CAST(event_id % 4 AS VARCHAR) ELSE '' END AS name,
    CASE WHEN k IN ('add', 'remove', 'drop', 'undrop') THEN 'player' WHEN k IN ('result', 'clear') THEN 'match' WHEN k IN ('go', 'pause', 'resume', 'reset') THEN 'clock' ELSE 'contest' END AS thing,
    row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id) AS n
  FROM (SELECT *, (['start', 'add', 'result', 'drop', 'go', 'undrop', 'pause', 'cut', 'clear', 'resume', 'finish', 'reopen', 'reset', 'uncut', 'remove', 'add', 'unstart', 'rename'])[CAST(floor(value * 100) AS BIGINT) % 18 + 1] AS k FROM events)
), p AS (
  SELECT DISTINCT contest, 0::BIGINT AS n, 0 AS phase FROM c
  UNION ALL
  SELECT c.contest, c.n, CASE k || phase WHEN 'start0' THEN 1 WHEN 'unstart1' THEN 0 WHEN 'cut1' THEN 2 WHEN 'uncut2' THEN 1 WHEN 'finish1' THEN 3 WHEN 'finish2' THEN 4 WHEN 'reopen3' THEN 1 WHEN 'reopen4' THEN 2 ELSE phase END
  FROM p JOIN c ON c.contest = p.contest AND c.n = p.n + 1
), e AS (
  SELECT c.*, phase, row_number() OVER (PARTITION BY c.contest, thing, name ORDER BY c.n) AS i FROM c JOIN p ON p.contest = c.contest AND p.n = c.n - 1
), q AS (
  SELECT DISTINCT contest, thing, name, 0::BIGINT AS i, 0 AS state, 0 AS fits FROM e WHERE thing <> 'contest'
  UNION ALL
  SELECT contest, thing, name, i, coalesce(new, state), CASE WHEN new IS NULL THEN 0 ELSE 1 END FROM (
    SELECT e.contest, e.thing, e.name, e.i, q.state, CASE
      WHEN k = 'add' AND phase <= 1 AND state = 0 THEN 1 WHEN k = 'remove' AND phase = 0 AND state = 1 THEN 0 WHEN k = 'reset' AND phase <= 2 AND state > 0 THEN 0 WHEN phase NOT IN (1, 2) THEN NULL
      WHEN k = 'drop' AND state = 1 THEN 2 WHEN k = 'undrop' AND state = 2 THEN 1 WHEN k = 'result' THEN 1 WHEN k = 'clear' AND state = 1 THEN 0
      WHEN k = 'go' AND state = 0 THEN 1 WHEN k = 'pause' AND state = 1 THEN 2 WHEN k = 'resume' AND state = 2 THEN 1 END AS new
    FROM q JOIN e ON e.contest = q.contest AND e.thing = q.thing AND e.name = q.name AND e.i = q.i + 1)
), f AS (
  SELECT contest, thing, name, arg_max(state, i) AS ends, sum(fits) AS applied, count(*) - 1 - sum(fits) AS refused FROM q GROUP BY 1, 2, 3
  UNION ALL
  SELECT e.contest, 'contest', '', max(z.phase), sum(CASE WHEN a.phase <> e.phase THEN 1 ELSE 0 END), sum(CASE WHEN a.phase <> e.phase THEN 0 ELSE 1 END)
  FROM e JOIN p a ON a.contest = e.contest AND a.n = e.n JOIN (SELECT contest, arg_max(phase, n) AS phase FROM p GROUP BY 1) z ON z.contest = e.contest WHERE thing = 'contest' GROUP BY 1
)
SELECT contest, thing, name, CASE thing WHEN 'player' THEN (['absent', 'in', 'dropped'])[ends + 1] WHEN 'match' THEN (['none', 'set'])[ends + 1] WHEN 'clock' THEN (['idle', 'going', 'paused'])[ends + 1]
  ELSE (['open', 'running', 'playoff', 'finished', 'finished after playoff'])[ends + 1] END AS state, CAST(applied AS BIGINT) AS applied, CAST(refused AS BIGINT) AS refused FROM f
""")
def command_log(t: Tables) -> DataFrame:
    """Events as commands of contests: sixteen kinds and one that is not known."""
    kinds = ["start", "add", "result", "drop", "go", "undrop", "pause", "cut", "clear", "resume", "finish", "reopen", "reset", "uncut", "remove", "add", "unstart", "rename"]
    kind = F.array(*map(F.lit, kinds))[(F.floor(F.col("value") * 100) % len(kinds)).cast("int")]
    rows = t.events.select((F.col("user_id") % 40).alias("contest"), F.col("event_id").alias("seq"), kind.alias("kind"), F.floor(F.col("user_id") / 40).alias("u"))
    name = F.when(F.col("kind").isin("result", "clear"), F.col("seq") % 4).otherwise(F.col("u") % 3).cast("string")
    return replayed_log(rows.select("contest", "seq", "kind", name.alias("name")))
