"""Holdings, lists and allocation. Line items are copies, suppliers their places, orders the lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.inventory import grouped, located
from ..operators.multiset import change_kind, compared, counted, rank_matched, waterfall
from ..operators.rank import numbered
from .registry import Tables, query


@query("""
WITH v AS (SELECT l_partkey AS item, l_returnflag AS variant, count(*) AS n, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1, 2),
p AS (SELECT l_partkey AS item, l_suppkey AS place, count(*) AS n FROM lineitem GROUP BY 1, 2),
r AS (SELECT item, variant, row_number() OVER (PARTITION BY item ORDER BY n DESC, variant) AS r FROM v),
q AS (SELECT item, place, n, row_number() OVER (PARTITION BY item ORDER BY n DESC, place) AS r FROM p)
SELECT item, CAST(sum(n) AS BIGINT) AS copies, count(*) AS variants, CAST(max(shipped) AS DATE) AS latest,
  (SELECT variant FROM r WHERE r.item = v.item AND r = 1) AS representative,
  (SELECT count(*) FROM p WHERE p.item = v.item) AS places, (SELECT place FROM q WHERE q.item = v.item AND r = 1) AS main_place
FROM v GROUP BY item
""")
def holdings_grouped(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_partkey").alias("item"), F.col("l_returnflag").alias("variant"), F.col("l_suppkey").alias("place"), F.col("l_shipdate").alias("at"))
    out = grouped(rows, "item", "variant", "place", "at")
    return out.select("item", "copies", F.size("variants").cast("long").alias("variants"), F.to_date("latest").alias("latest"), "representative", F.size("places").cast("long").alias("places"), F.col("places")[0]["key"].alias("main_place"))


@query("""
SELECT CASE WHEN s_suppkey % 3 = 0 THEN coalesce(n_name, s_name) ELSE s_name END AS "where", count(*) AS copies
FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey AND s_suppkey % 2 = 0 GROUP BY 1
""")
def where_is(t: Tables) -> DataFrame:
    places = t.supplier.select(
        F.col("s_suppkey").alias("place"), F.col("s_name").alias("place_name"), F.when(F.col("s_suppkey") % 3 == 0, "deck").otherwise("box").alias("place_type"),
        F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey")).alias("owner"),
    )
    lists = t.nation.select(F.col("n_nationkey").alias("owner"), F.col("n_name").alias("list_name"))
    per = t.lineitem.groupBy(F.col("l_suppkey").alias("place")).agg(F.count(F.lit(1)).alias("n"))
    return located(per, places, lists, "place", "owner").groupBy("where").agg(F.sum("n").alias("copies"))


@query("""
SELECT l_suppkey % 10 AS owner, count(*) AS copies, count(DISTINCT l_partkey) AS items, count(DISTINCT l_returnflag) AS finishes
FROM lineitem GROUP BY 1
""")
def owner_counts(t: Tables) -> DataFrame:
    return t.lineitem.groupBy((F.col("l_suppkey") % 10).alias("owner")).agg(F.count(F.lit(1)).alias("copies"), F.countDistinct("l_partkey").alias("items"), F.countDistinct("l_returnflag").alias("finishes"))


ALLOCATED = """
WITH li AS (SELECT l_partkey AS item, CAST(l_quantity AS BIGINT) AS q, o_orderstatus AS s, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
d AS (SELECT item, CAST(sum(q) AS BIGINT) AS needed FROM li WHERE s = 'O' GROUP BY 1),
u AS (SELECT item, CAST(sum(CASE WHEN l_suppkey % 3 = 0 THEN q ELSE 0 END) AS BIGINT) AS here,
  CAST(sum(CASE WHEN l_suppkey % 3 = 1 THEN q ELSE 0 END) AS BIGINT) AS free, CAST(sum(CASE WHEN l_suppkey % 3 = 2 THEN q ELSE 0 END) AS BIGINT) AS elsewhere
  FROM li WHERE s = 'F' GROUP BY 1),
a AS (SELECT item, needed, least(needed, coalesce(here, 0)) AS here, needed - least(needed, coalesce(here, 0)) AS missing, coalesce(free, 0) AS f, coalesce(elsewhere, 0) AS e
  FROM d LEFT JOIN u USING (item)),
b AS (SELECT *, least(missing, f) AS move FROM a), c AS (SELECT *, least(missing - move, e) AS conflict FROM b),
w AS (SELECT item, needed, here, missing, move, conflict, missing - move - conflict AS buy FROM c)
"""


def allocated(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("s")), "l_orderkey").select(F.col("l_partkey").alias("item"), F.col("l_quantity").cast("long").alias("q"), "s", "l_suppkey")
    demand = rows.where("s = 'O'").groupBy("item").agg(F.sum("q").alias("needed"))
    kind = lambda k: F.sum(F.when(F.col("l_suppkey") % 3 == k, F.col("q")).otherwise(0))
    supply = rows.where("s = 'F'").groupBy("item").agg(kind(0).alias("here"), kind(1).alias("free"), kind(2).alias("elsewhere"))
    return waterfall(demand, supply, ["item"])


@query(ALLOCATED + """
SELECT *, CASE WHEN conflict > 0 THEN 'conflict' WHEN buy > 0 THEN 'buy' WHEN move > 0 THEN 'move' ELSE 'ok' END AS status FROM w
""")
def allocation_waterfall(t: Tables) -> DataFrame:
    return allocated(t)


@query(ALLOCATED + """
SELECT count(*) AS items, CAST(sum(needed) AS BIGINT) AS needed, CAST(sum(here) AS BIGINT) AS here, CAST(sum(move) AS BIGINT) AS move,
  CAST(sum(conflict) AS BIGINT) AS conflict, CAST(sum(buy) AS BIGINT) AS buy FROM w
""")
def allocation_totals(t: Tables) -> DataFrame:
    return allocated(t).agg(F.count(F.lit(1)).alias("items"), *[F.sum(c).alias(c) for c in ("needed", "here", "move", "conflict", "buy")])


@query(ALLOCATED + """
SELECT part, name, section, n, CASE WHEN section = 'buy' THEN round(p_retailprice * n, 2) END AS cost FROM (
  SELECT item, 'buy' AS section, buy AS n FROM w WHERE buy > 0 UNION ALL SELECT item, 'decide', conflict FROM w WHERE conflict > 0
  UNION ALL SELECT item, 'fetch', move FROM w WHERE move > 0) x JOIN (SELECT p_partkey AS part, p_name AS name, p_retailprice FROM part) ON part = item
""")
def shopping_list(t: Tables) -> DataFrame:
    """What to buy (priced), to decide and to fetch."""
    sections = F.array(*[F.struct(F.lit(s).alias("section"), F.col(c).alias("n")) for s, c in (("buy", "buy"), ("decide", "conflict"), ("fetch", "move"))])
    rows = allocated(t).select("item", F.explode(sections).alias("x")).where("x.n > 0")
    rows = rows.join(t.part, F.col("item") == F.col("p_partkey"))
    cost = F.when(F.col("x.section") == "buy", F.round(F.col("p_retailprice") * F.col("x.n"), 2))
    return rows.select(F.col("item").alias("part"), F.col("p_name").alias("name"), "x.section", "x.n", cost.alias("cost"))


@query("""
WITH c AS (
  SELECT l_partkey AS item, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_shipdate,
    row_number() OVER (PARTITION BY l_partkey ORDER BY l_returnflag <> 'N', l_suppkey % 2, l_shipdate, l_orderkey, l_linenumber, l_extendedprice) AS k FROM lineitem)
SELECT item, count(*) AS moved, min(l_orderkey) AS first_list, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM c WHERE k <= item % 5 GROUP BY item
""")
def allocation_plan(t: Tables) -> DataFrame:
    """The copies to move: the wanted print first, loose ones before others, oldest first."""
    order = [F.col("l_returnflag") != "N", F.col("l_suppkey") % 2, F.col("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_extendedprice")]
    rows = numbered(t.lineitem.withColumn("item", F.col("l_partkey")), ["item"], order, "k").where(F.col("k") <= F.col("item") % 5)
    return rows.groupBy("item").agg(F.count(F.lit(1)).alias("moved"), F.min("l_orderkey").alias("first_list"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


HALVES = """
WITH a AS (SELECT l_partkey AS item, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-06-01' GROUP BY 1),
b AS (SELECT l_partkey AS item, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01' GROUP BY 1),
j AS (SELECT coalesce(a.item, b.item) AS item, coalesce(a.q, 0) AS e, coalesce(b.q, 0) AS f FROM a FULL JOIN b ON a.item = b.item)
"""


def halves(t: Tables) -> tuple[DataFrame, DataFrame]:
    cut = F.to_timestamp_ntz(F.lit("1998-06-01 00:00:00"))
    rows = t.lineitem.withColumn("item", F.col("l_partkey"))
    return tuple(counted(rows.where(c), ["item"], F.col("l_quantity")) for c in (F.col("l_shipdate") < cut, F.col("l_shipdate") >= cut))


@query(HALVES + """
SELECT item, e AS before, f AS after, CASE WHEN e = 0 THEN 'added' WHEN f = 0 THEN 'removed' WHEN e <> f THEN 'changed' ELSE 'same' END AS kind FROM j
""")
def list_diff(t: Tables) -> DataFrame:
    rows = compared(*halves(t), ["item"])
    return rows.select("item", F.col("expected").alias("before"), F.col("found").alias("after"), change_kind(F.col("expected"), F.col("found")).alias("kind"))


@query(HALVES + """
SELECT CAST(sum(e) AS BIGINT) AS expected, CAST(sum(f) AS BIGINT) AS found, CAST(sum(least(e, f)) AS BIGINT) AS ok,
  CAST(sum(greatest(e - f, 0)) AS BIGINT) AS missing, CAST(sum(greatest(f - e, 0)) AS BIGINT) AS extra FROM j
""")
def reverse_check(t: Tables) -> DataFrame:
    return compared(*halves(t), ["item"]).agg(*[F.sum(c).alias(c) for c in ("expected", "found", "ok", "missing", "extra")])


@query("""
WITH a AS (SELECT l_returnflag || l_linenumber || '/' || l_suppkey AS k FROM lineitem WHERE l_linestatus = 'O'), b AS (SELECT l_returnflag || l_linenumber || '/' || l_suppkey AS k FROM lineitem WHERE l_linestatus = 'F')
SELECT 'intersect' AS op, k, count(*) AS n FROM (SELECT k FROM a INTERSECT ALL SELECT k FROM b) GROUP BY k
UNION ALL SELECT 'except', k, count(*) FROM (SELECT k FROM a EXCEPT ALL SELECT k FROM b) GROUP BY k
UNION ALL SELECT 'union', k, count(*) FROM (SELECT k FROM a UNION SELECT k FROM b) GROUP BY k
""")
def multiset_ops(t: Tables) -> DataFrame:
    key = F.concat("l_returnflag", F.col("l_linenumber").cast("string"), F.lit("/"), F.col("l_suppkey").cast("string")).alias("k")
    a, b = (t.lineitem.where(F.col("l_linestatus") == s).select(key) for s in "OF")
    parts = {"intersect": a.intersectAll(b), "except": a.exceptAll(b), "union": a.union(b).distinct()}
    counts = [df.groupBy("k").agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "k", "n") for op, df in parts.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("""
WITH s AS (SELECT l_partkey AS item, event_no, row_number() OVER (PARTITION BY l_partkey ORDER BY event_no) AS k FROM
    (SELECT l_partkey, l_orderkey * 10000 + l_suppkey * 10 + l_linenumber AS event_no, l_extendedprice FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag = 'A') ),
c AS (SELECT l_partkey AS item, copy_no, row_number() OVER (PARTITION BY l_partkey ORDER BY copy_no) AS k FROM
    (SELECT l_partkey, l_orderkey * 10000 + l_suppkey * 10 + l_linenumber AS copy_no FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag = 'A'))
SELECT coalesce(s.item, c.item) AS item, count(s.item) FILTER (WHERE c.item IS NOT NULL) AS matched, count(*) FILTER (WHERE c.item IS NULL) AS created,
  count(*) FILTER (WHERE s.item IS NULL) AS released FROM s FULL JOIN c ON s.item = c.item AND s.k = c.k GROUP BY 1
""")
def rescan_match(t: Tables) -> DataFrame:
    """The k-th sighting of an item is its k-th copy; what is left over is created or released."""
    number = F.col("l_orderkey") * 10000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")
    rows = t.lineitem.where("l_returnflag = 'A'").select(F.col("l_partkey").alias("item"), "l_linestatus", number.alias("no"))
    seen, held = rows.where("l_linestatus = 'O'").select("item", F.col("no").alias("seen")), rows.where("l_linestatus = 'F'").select("item", F.col("no").alias("held"))
    both = rank_matched(seen, held, ["item"], [F.col("seen")], [F.col("held")])
    has = F.col("seen").isNotNull(), F.col("held").isNotNull()
    return both.groupBy("item").agg(F.count_if(has[0] & has[1]).alias("matched"), F.count_if(~has[1]).alias("created"), F.count_if(~has[0]).alias("released"))


@query("""
SELECT l_partkey AS item, l_returnflag AS zone, l_linestatus AS lang, CAST(sum(l_quantity) AS BIGINT) AS quantity, arg_min(l_suppkey, (l_orderkey, l_linenumber, l_suppkey)) AS first_place
FROM lineitem GROUP BY 1, 2, 3
""")
def merge_lines(t: Tables) -> DataFrame:
    """Lines of one item, zone and language become one, with the first line's other fields."""
    keys = [F.col("l_partkey").alias("item"), F.col("l_returnflag").alias("zone"), F.col("l_linestatus").alias("lang")]
    return t.lineitem.groupBy(*keys).agg(F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.min_by("l_suppkey", F.struct("l_orderkey", "l_linenumber", "l_suppkey")).alias("first_place"))


@query("""
SELECT a.l_partkey AS item, array_to_string(list_sort(list(DISTINCT 'Order ' || b.l_orderkey)), ', ') AS lists
FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey = (SELECT min(l_orderkey) FROM lineitem)) a
JOIN lineitem b ON a.l_partkey = b.l_partkey AND b.l_orderkey <> (SELECT min(l_orderkey) FROM lineitem) GROUP BY 1
""")
def owned_elsewhere(t: Tables) -> DataFrame:
    """For the items of one list, the names of the other lists that have them."""
    first = t.lineitem.agg(F.min("l_orderkey").alias("list"))
    mine = t.lineitem.join(F.broadcast(first), F.col("l_orderkey") == F.col("list")).select("l_partkey").distinct()
    other = t.lineitem.join(F.broadcast(first), F.col("l_orderkey") != F.col("list")).join(mine, "l_partkey")
    names = F.array_join(F.sort_array(F.collect_set(F.concat(F.lit("Order "), F.col("l_orderkey").cast("string")))), ", ")
    return other.groupBy(F.col("l_partkey").alias("item")).agg(names.alias("lists"))


@query("""
WITH o AS (SELECT l_orderkey, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS q, count(*) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)
SELECT o_orderkey AS list, c_name AS owner, coalesce(n, 0) AS lines, coalesce(q, 0) AS quantity, coalesce(r, 0) AS returned
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN o ON o_orderkey = l_orderkey
""")
def list_overview(t: Tables) -> DataFrame:
    """Lists with their owners and counts; the counts are aggregated before the join."""
    per = t.lineitem.groupBy(F.col("l_orderkey").alias("list")).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    rows = t.orders.select(F.col("o_orderkey").alias("list"), F.col("o_custkey").alias("c_custkey")).join(t.customer.select("c_custkey", F.col("c_name").alias("owner")), "c_custkey", "left")
    return rows.join(per, "list", "left").fillna(0, ["lines", "quantity", "returned"]).drop("c_custkey")


@query("""
WITH s AS (SELECT l_partkey AS item, count(*) AS seen FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
h AS (SELECT l_partkey AS item, count(*) FILTER (WHERE l_suppkey % 4 = 0) AS in_target, count(*) FILTER (WHERE l_suppkey % 4 <> 0) AS elsewhere FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1)
SELECT item, seen, coalesce(in_target, 0) AS in_target, coalesce(elsewhere, 0) AS elsewhere, greatest(seen - coalesce(in_target, 0), 0) AS to_create FROM s LEFT JOIN h USING (item)
""")
def save_preview(t: Tables) -> DataFrame:
    seen = t.lineitem.where("l_returnflag = 'A'").groupBy(F.col("l_partkey").alias("item")).agg(F.count(F.lit(1)).alias("seen"))
    target = F.col("l_suppkey") % 4 == 0
    held = t.lineitem.where("l_returnflag = 'N'").groupBy(F.col("l_partkey").alias("item")).agg(F.count_if(target).alias("in_target"), F.count_if(~target).alias("elsewhere"))
    rows = seen.join(held, "item", "left").fillna(0, ["in_target", "elsewhere"])
    return rows.withColumn("to_create", F.greatest(F.col("seen") - F.col("in_target"), F.lit(0).cast("long")))


@query("""
WITH d AS (SELECT event_id AS id, user_id AS capture, CASE WHEN value > 40 THEN event_id - event_id % 7 END AS dup_of FROM events)
SELECT capture, count(*) AS kept FROM d WHERE NOT EXISTS (SELECT 1 FROM d e WHERE e.id = d.dup_of AND e.id <> d.id) GROUP BY 1
""")
def representatives(t: Tables) -> DataFrame:
    """Rows that are no duplicate of another row of the set."""
    rows = t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("capture"), F.when(F.col("value") > 40, F.col("event_id") - F.col("event_id") % 7).alias("dup_of"))
    others = rows.select(F.col("id").alias("other"))
    kept = rows.join(others, (F.col("dup_of") == F.col("other")) & (F.col("other") != F.col("id")), "left_anti")
    return kept.groupBy("capture").agg(F.count(F.lit(1)).alias("kept"))
