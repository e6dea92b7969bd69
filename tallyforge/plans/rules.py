"""Rule queries. Parts are cards, line items are list lines and orders are lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import Predicates
from ..operators.rank import apportion
from ..operators.rules import bracket, copy_issues, legality, limited, pips, zone_issues
from .registry import Tables, query


@query(r"""
SELECT p_partkey AS part,
  contains(lower(p_name), 'gear') OR (p_size >= 40 AND p_type IN ('PROMO', 'LARGE')) AS tagged,
  regexp_matches(p_name, '^(red|blue) ') AND NOT p_brand = 'Brand#7' AS colored,
  list_contains(string_split(p_name, ' '), 'ring') AS listed, false AS never, true AS always_,
  nullif(regexp_extract(p_brand, 'Brand#(\d+)', 1), '') AS number
FROM part
""")
def predicate_rules(t: Tables) -> DataFrame:
    df = t.part.withColumn("words", F.split("p_name", " "))
    p = Predicates(df)
    rules = {
        "tagged": {"any": [{"p_name_contains": "GEAR"}, {"all": [{"p_size_gte": 40}, {"p_type_in": ["PROMO", "LARGE"]}]}]},
        "colored": {"all": [{"p_name_regex": "^(?P<color>red|blue) "}, {"not": {"p_brand_equals": "Brand#7"}}]},
        "listed": {"words_includes": "ring"}, "never": {}, "always_": {"always": True},
    }
    return df.select(F.col("p_partkey").alias("part"), *[p.compile(r).alias(n) for n, r in rules.items()], p.captures("p_brand", r"Brand#(?P<n>\d+)")["n"].alias("number"))


LINES = """
WITH l AS (
  SELECT l_orderkey AS list, l_partkey % 40 AS card, l_linenumber AS position, l_suppkey, CAST(l_quantity % 6 AS BIGINT) + 1 AS detected,
    CASE WHEN l_suppkey % 17 = 0 THEN 0 WHEN l_suppkey % 19 = 0 THEN 9 END AS override, l_extendedprice
  FROM lineitem
), m AS (SELECT l.*, list * 100 + card AS key, CASE WHEN card % 10 = 3 THEN 1 WHEN card % 10 = 0 THEN NULL WHEN card % 10 = 1 THEN 7 ELSE 4 END AS lim FROM l),
r AS (SELECT *, coalesce(sum(detected) OVER (PARTITION BY key ORDER BY position, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m),
q AS (SELECT *, CASE WHEN lim IS NULL THEN detected ELSE least(detected, greatest(lim - before, 0)) END AS automatic FROM r),
f AS (SELECT *, coalesce(override, automatic) AS quantity FROM q)
"""
RULE = {
    "default": 4,
    "restricted": {"text_equals": "restricted"},
    "exceptions": [{"when": {"text_equals": "basic"}, "limit": None}, {"when": {"text_contains": "up to"}, "limit": {"field": "text", "pattern": r"up to (?P<n>\w+)"}}],
}


def lines(t: Tables) -> DataFrame:
    card = F.col("l_partkey") % 40
    text = F.when(card % 10 == 3, "restricted").when(card % 10 == 0, "basic").when(card % 10 == 1, "A deck can have up to seven cards").otherwise("plain")
    override = F.when(F.col("l_suppkey") % 17 == 0, 0).when(F.col("l_suppkey") % 19 == 0, 9)
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("list"), card.alias("card"), (F.col("l_orderkey") * 100 + card).alias("key"), text.alias("text"), F.col("l_linenumber").alias("position"),
        "l_suppkey", "l_extendedprice", ((F.col("l_quantity") % 6).cast("long") + 1).alias("detected"), override.cast("long").alias("override"),
    )
    return limited(rows, RULE, "key", [F.col("position"), F.col("l_suppkey"), F.col("l_extendedprice")])


@query(LINES + """
SELECT key, CAST(sum(detected) AS BIGINT) AS detected, CAST(sum(quantity) AS BIGINT) AS quantity, max(lim) AS "limit" FROM f GROUP BY key
""")
def copy_limit(t: Tables) -> DataFrame:
    return lines(t).groupBy("key").agg(F.sum("detected").alias("detected"), F.sum("quantity").alias("quantity"), F.max("limit").alias("limit"))


@query(LINES + """
, k AS (SELECT key, sum(detected) AS d, sum(quantity) AS q, max(lim) AS lim FROM f GROUP BY key)
SELECT code, CASE code WHEN 'copy_limit_violation' THEN 'error' ELSE 'warning' END AS severity, count(*) AS n FROM (
  SELECT CASE WHEN q > lim THEN 'copy_limit_violation' WHEN d > lim THEN 'copy_limit_exceeded' END AS code FROM k) WHERE code IS NOT NULL GROUP BY 1, 2
""")
def copy_limit_issues(t: Tables) -> DataFrame:
    return copy_issues(lines(t), "key").groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH z AS (SELECT l_orderkey AS list, CASE l_returnflag WHEN 'N' THEN 'main' WHEN 'A' THEN 'side' ELSE 'odd' END AS zone, CAST(sum(l_quantity) AS BIGINT) AS quantity
  FROM lineitem GROUP BY 1, 2)
SELECT list, zone, quantity, CASE WHEN zone = 'main' AND quantity < 60 THEN 'too_few' WHEN zone = 'side' AND quantity > 15 THEN 'too_many' ELSE 'unknown_zone' END AS code,
  CASE WHEN zone = 'main' THEN 60 - quantity WHEN zone = 'side' THEN quantity - 15 ELSE quantity END AS gap
FROM z WHERE (zone = 'main' AND quantity < 60) OR (zone = 'side' AND quantity > 15) OR (zone = 'odd' AND quantity > 0)
""")
def zone_totals(t: Tables) -> DataFrame:
    zone = F.when(F.col("l_returnflag") == "N", "main").when(F.col("l_returnflag") == "A", "side").otherwise("odd")
    rows = t.lineitem.select(F.col("l_orderkey").alias("list"), zone.alias("zone"), F.col("l_quantity").cast("long").alias("quantity"))
    return zone_issues(rows, ["list"], {"main": (60, None), "side": (None, 15)})


@query("""
WITH s AS (SELECT l_orderkey AS list, list_distinct(list(l_returnflag)) AS mine, list_distinct(list(l_returnflag) FILTER (WHERE l_linenumber <= 2)) AS lead FROM lineitem GROUP BY 1)
SELECT list, coalesce(len(list_filter(mine, lambda x: NOT list_contains(coalesce(lead, []), x))), 0) = 0 AS inside,
  array_to_string(list_filter(['N', 'A', 'R'], lambda x: list_contains(mine, x)), '') AS identity FROM s
""")
def identity_subset(t: Tables) -> DataFrame:
    """Whether a list's colours are among its leaders', and its colours in fixed order."""
    per = t.lineitem.groupBy(F.col("l_orderkey").alias("list")).agg(F.collect_set("l_returnflag").alias("mine"), F.collect_set(F.when(F.col("l_linenumber") <= 2, F.col("l_returnflag"))).alias("lead"))
    order = F.array(*[F.lit(x) for x in "NAR"])
    return per.select("list", (F.size(F.array_except("mine", "lead")) == 0).alias("inside"), F.array_join(F.filter(order, lambda x: F.array_contains(F.col("mine"), x)), "").alias("identity"))


@query("""
WITH w AS (SELECT c_nationkey AS nation, c_mktsegment AS segment, count(*) FILTER (WHERE c_nationkey <> 3) AS weight FROM customer GROUP BY 1, 2),
x AS (SELECT *, CASE WHEN sum(weight) OVER p > 0 THEN weight * 17.0 / sum(weight) OVER p ELSE 17.0 / count(*) OVER p END AS exact FROM w WINDOW p AS (PARTITION BY nation)),
y AS (SELECT *, floor(exact) AS base, row_number() OVER (PARTITION BY nation ORDER BY round(exact - floor(exact), 9) DESC, segment) AS nth FROM x)
SELECT nation, segment, CAST(base + CASE WHEN nth <= 17 - sum(base) OVER (PARTITION BY nation) THEN 1 ELSE 0 END AS BIGINT) AS slots FROM y
""")
def apportioned_slots(t: Tables) -> DataFrame:
    """17 slots a nation by largest remainder; a nation of zero weights shares equally."""
    rows = t.customer.groupBy(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).agg(F.count_if(F.col("c_nationkey") != 3).alias("weight"))
    return apportion(rows, ["nation"], "weight", F.lit(17.0), F.col("segment"), "slots").select("nation", "segment", "slots")


@query("""
WITH c AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN ['W', 'U/B'] WHEN 1 THEN ['R', 'R'] WHEN 2 THEN ['2/G'] WHEN 3 THEN ['W/P', 'U'] ELSE ['3'] END AS symbols, p_size FROM part),
s AS (SELECT p_partkey, p_size, unnest(symbols) AS s FROM c), k AS (
  SELECT p_partkey, p_size, CASE WHEN contains(s, '/') THEN 0.5 ELSE 1.0 END AS weight, unnest(list_filter(string_split(s, '/'), lambda x: x IN ('W', 'U', 'B', 'R', 'G'))) AS color FROM s)
SELECT color, CAST(sum(weight * 2) AS DOUBLE) AS pips, max(p_size <= 2) AS early FROM k GROUP BY color
""")
def pip_counts(t: Tables) -> DataFrame:
    size = F.col("p_size") % 5
    cost = F.when(size == 0, "{W}{U/B}").when(size == 1, "{R}{R}").when(size == 2, "{2/G}").when(size == 3, "{W/P}{U}").otherwise("{3}")
    rows = t.part.select("p_size", F.explode(pips(cost)).alias("pip"))
    return rows.groupBy("pip.color").agg(F.sum(F.col("pip.weight") * 2).alias("pips"), F.max(F.col("p_size") <= 2).alias("early"))


@query("""
WITH p AS (SELECT l_orderkey AS list, count(DISTINCT l_partkey) FILTER (WHERE l_quantity > 40) AS big, count(DISTINCT l_partkey) FILTER (WHERE l_discount > 0.08) AS cheap,
  count(DISTINCT l_partkey) FILTER (WHERE l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1)
SELECT CASE WHEN big = 0 AND cheap = 0 AND returned <= 1 THEN 1 WHEN big = 0 AND cheap <= 1 AND returned <= 2 THEN 2 WHEN big <= 2 THEN 3 ELSE 4 END AS bracket, count(*) AS lists FROM p GROUP BY 1
""")
def tag_bracket(t: Tables) -> DataFrame:
    tags = {"big": F.col("l_quantity") > 40, "cheap": F.col("l_discount") > 0.08, "returned": F.col("l_returnflag") == "R"}
    per = t.lineitem.groupBy(F.col("l_orderkey").alias("list")).agg(*[F.countDistinct(F.when(c, F.col("l_partkey"))).alias(n) for n, c in tags.items()])
    limits = [(1, {"big": 0, "cheap": 0, "returned": 1}), (2, {"big": 0, "cheap": 1, "returned": 2}), (3, {"big": 2})]
    return per.groupBy(bracket(per, limits).alias("bracket")).agg(F.count(F.lit(1)).alias("lists"))


@query("""
SELECT CASE WHEN p_size % 7 = 0 THEN 'banned' ELSE 'not_legal' END AS code, count(*) AS n FROM part WHERE p_size % 7 = 0 OR p_size % 11 = 0 GROUP BY 1
""")
def legality_issues(t: Tables) -> DataFrame:
    """Status at a key of a map column."""
    status = F.create_map(F.lit("modern"), F.when(F.col("p_size") % 7 == 0, "banned").when(F.col("p_size") % 11 == 0, F.lit(None)).otherwise("legal"))
    rows = t.part.select(legality(status["modern"]).alias("code"))
    return rows.where("code is not null").groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH l AS (SELECT l_orderkey AS list, count(*) FILTER (WHERE l_linenumber = 1) AS leaders, max(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS most,
  count(*) FILTER (WHERE l_linenumber = 1 AND p_size < 25) AS unfit FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT code, count(*) AS n FROM (
  SELECT unnest(list_filter([CASE WHEN leaders = 0 THEN 'missing' END, CASE WHEN leaders > 2 THEN 'too_many' END, CASE WHEN unfit > 0 THEN 'ineligible' END, CASE WHEN most > 45 THEN 'quantity' END], lambda x: x IS NOT NULL)) AS code FROM l)
GROUP BY code
""")
def leader_checks(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    lead = F.col("l_linenumber") == 1
    per = rows.groupBy("l_orderkey").agg(F.count_if(lead).alias("leaders"), F.max(F.when(lead, F.col("l_quantity"))).alias("most"), F.count_if(lead & (F.col("p_size") < 25)).alias("unfit"))
    codes = F.array_compact(F.array(F.when(F.col("leaders") == 0, "missing"), F.when(F.col("leaders") > 2, "too_many"), F.when(F.col("unfit") > 0, "ineligible"), F.when(F.col("most") > 45, "quantity")))
    return per.select(F.explode(codes).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT list, count(*) AS pairs, count(*) FILTER (WHERE both_) AS allowed FROM (
  SELECT a.l_orderkey AS list, (a.l_returnflag = 'R' AND b.l_returnflag = 'R') OR (a.l_returnflag = 'A' AND b.l_returnflag = 'N') AS both_
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.l_linenumber <= 2 AND b.l_linenumber <= 2)
GROUP BY list
""")
def leader_pairs(t: Tables) -> DataFrame:
    """The marked rows of a list in pairs, and which pairs a rule allows."""
    marked = t.lineitem.where("l_linenumber <= 2")
    a, b = marked.alias("a"), marked.alias("b")
    pairs = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_linenumber") < F.col("b.l_linenumber")))
    flags = F.col("a.l_returnflag"), F.col("b.l_returnflag")
    ok = ((flags[0] == "R") & (flags[1] == "R")) | ((flags[0] == "A") & (flags[1] == "N"))
    return pairs.groupBy(F.col("a.l_orderkey").alias("list")).agg(F.count(F.lit(1)).alias("pairs"), F.count_if(ok).alias("allowed"))
