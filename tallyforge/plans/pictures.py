"""Queries over boxes, photos and commands derived from embeddings and events, and the remaining filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import Predicates
from ..operators.entity import canonical_pairs, unique_anchors
from ..operators.graphs import overlaps, replayed, spanning_forest, suppressed_in_cells
from ..operators.multiset import compared
from ..operators.statistics import order_statistic
from .registry import Tables, query

BOXES = """
WITH RECURSIVE b AS (SELECT label AS g, vec_id AS id, CAST(embedding[1] AS DOUBLE) AS "left", CAST(embedding[2] AS DOUBLE) AS top,
  CAST(embedding[1] AS DOUBLE) + 0.1 AS "right", CAST(embedding[2] AS DOUBLE) + 0.1 AS bottom, CAST(embedding[3] AS DOUBLE) AS score FROM embeddings),
o AS (SELECT x.g, x.id AS a, y.id AS b, greatest(0, least(x."right", y."right") - greatest(x."left", y."left")) * greatest(0, least(x.bottom, y.bottom) - greatest(x.top, y.top)) AS both_
  FROM b x JOIN b y ON x.g = y.g AND x.id < y.id),
p AS (SELECT g, a, b, both_ / (0.02 - both_) AS iou FROM o WHERE both_ / (0.02 - both_) >= 0.55)
"""


def boxes(t: Tables) -> DataFrame:
    e = lambda i: F.col("embedding")[i].cast("double")
    return t.embeddings.select(F.col("label").alias("g"), F.col("vec_id").alias("id"), e(0).alias("left"), e(1).alias("top"), (e(0) + 0.1).alias("right"), (e(1) + 0.1).alias("bottom"), e(2).alias("score"))


def pairs(t: Tables) -> DataFrame:
    return overlaps(boxes(t), boxes(t), ["g"], 0.1).where("a < b")


@query(BOXES + "SELECT g, a, b, round(iou, 5) AS iou FROM p")
def box_overlaps(t: Tables) -> DataFrame:
    """Boxes of one picture that nearly coincide (a spatial join through grid cells)."""
    return pairs(t).select("g", "a", "b", F.round("iou", 5).alias("iou"))


@query(BOXES + """
SELECT g, a, b FROM (SELECT *, row_number() OVER (PARTITION BY g, a ORDER BY iou DESC, b) AS r FROM p) WHERE r = 1
""")
def best_overlap(t: Tables) -> DataFrame:
    return pairs(t).groupBy("g", "a").agg(F.min_by("b", F.struct(-F.col("iou"), F.col("b"))).alias("b"))


@query(BOXES + """
, near AS (SELECT g, a AS id, b AS other FROM p UNION ALL SELECT g, b, a FROM p),
l AS (SELECT b.g, b.id, row_number() OVER (PARTITION BY b.g ORDER BY score DESC, b.id) AS n, (SELECT coalesce(list(other), []) FROM near WHERE near.g = b.g AND near.id = b.id) AS others FROM b),
r AS (SELECT g, n, [id] AS kept FROM l WHERE n = 1
  UNION ALL SELECT l.g, l.n, CASE WHEN list_has_any(kept, others) THEN kept ELSE list_append(kept, l.id) END FROM r JOIN l ON l.g = r.g AND l.n = r.n + 1)
SELECT g, unnest(max_by(kept, n)) AS id FROM r GROUP BY g
""")
def suppressed_boxes(t: Tables) -> DataFrame:
    """The boxes that greedy suppression keeps."""
    return suppressed_in_cells(boxes(t), ["g"], 0.1).select("g", "id")


@query(BOXES + """
SELECT g, id, row_number() OVER (PARTITION BY g ORDER BY round_even(top / 0.1, 0), "left", id) AS place FROM b
""")
def reading_order(t: Tables) -> DataFrame:
    """Rows of the picture from the top, each from the left."""
    w = Window.partitionBy("g").orderBy(F.bround(F.col("top") / 0.1), "left", "id")
    return boxes(t).select("g", "id", F.row_number().over(w).cast("long").alias("place"))


@query("""
WITH RECURSIVE w AS (SELECT CAST(c_nationkey AS BIGINT) AS a, o_orderkey % 25 AS b, count(*) AS weight FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
p AS (SELECT least(a, b) AS a, greatest(a, b) AS b, max(weight) AS weight FROM w WHERE a <> b GROUP BY 1, 2),
e AS (SELECT *, row_number() OVER (ORDER BY weight DESC, a, b) AS n FROM p),
u AS (SELECT a, b, n FROM e UNION ALL SELECT b, a, n FROM e),
reach AS (SELECT n, a AS node FROM e UNION SELECT reach.n, u.b FROM reach JOIN u ON u.a = reach.node AND u.n < reach.n)
SELECT a, b, weight FROM e WHERE NOT EXISTS (SELECT 1 FROM reach WHERE reach.n = e.n AND reach.node = e.b)
""")
def registration_forest(t: Tables) -> DataFrame:
    """Nations that trade most, joined in a maximum spanning forest."""
    return spanning_forest(trade(t))


def trade(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select((F.col("c_nationkey").cast("long")).alias("a"), (F.col("o_orderkey") % 25).alias("b"))
    return rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))


@query("""
WITH RECURSIVE e AS (SELECT user_id % 20 AS contest, event_id AS seq, user_id AS player, CAST(floor(value) AS BIGINT) AS amount,
  CASE WHEN event_type = 'error' THEN 'undo' WHEN event_type = 'signup' AND value > 80 THEN 'drop' ELSE 'add' END AS kind FROM events),
d AS (SELECT contest, player, min(seq) AS closed FROM e WHERE kind = 'drop' GROUP BY 1, 2),
c AS (SELECT e.*, row_number() OVER (PARTITION BY contest ORDER BY seq) AS n FROM e LEFT JOIN d USING (contest, player) WHERE kind = 'undo' OR kind = 'add' AND (closed IS NULL OR seq < closed)),
r AS (SELECT DISTINCT contest, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS stack FROM c
  UNION ALL SELECT c.contest, c.n, CASE kind WHEN 'add' THEN list_append(stack, seq) ELSE stack[1:len(stack) - 1] END FROM r JOIN c ON c.contest = r.contest AND c.n = r.n + 1),
s AS (SELECT unnest(max_by(stack, n)) AS seq FROM r GROUP BY contest)
SELECT contest, player, CAST(sum(amount) AS BIGINT) AS score, count(*) AS changes FROM s JOIN e USING (seq) GROUP BY 1, 2
""")
def command_replay(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "undo").when((F.col("event_type") == "signup") & (F.col("value") > 80), "drop").otherwise("add")
    rows = t.events.select((F.col("user_id") % 20).alias("contest"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("user_id").alias("player"), F.floor("value").alias("amount"))
    return replayed(rows)


@query("""
SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE l_partkey <> l_suppkey
""")
def blocked_pairs(t: Tables) -> DataFrame:
    return canonical_pairs(t.lineitem, "l_partkey", "l_suppkey")


@query("""
SELECT a.k AS part FROM (SELECT l_partkey || '/' || l_suppkey AS k FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1 HAVING count(*) = 1) a
JOIN (SELECT l_partkey || '/' || l_suppkey AS k FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1 HAVING count(*) = 1) b ON a.k = b.k
""")
def anchors(t: Tables) -> DataFrame:
    side = lambda s: t.lineitem.where(F.col("l_linestatus") == s).select(F.concat_ws("/", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("part"))
    return unique_anchors(side("O"), side("F"), "part")


@query("""
WITH a AS (SELECT DISTINCT p_name FROM part WHERE p_size = 3), b AS (SELECT DISTINCT p_name FROM part WHERE p_size = 4)
SELECT p_name AS name, 'removed' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT p_name, 'added' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
""")
def list_sync(t: Tables) -> DataFrame:
    a, b = t.part.where("p_size = 3").select("p_name"), t.part.where("p_size = 4").select("p_name")
    return a.subtract(b).select(F.col("p_name").alias("name"), F.lit("removed").alias("change")).unionByName(b.subtract(a).select(F.col("p_name").alias("name"), F.lit("added").alias("change")))


@query("""
WITH t AS (SELECT p_type AS k, count(*) AS e FROM part WHERE p_size % 2 = 0 GROUP BY 1), d AS (SELECT p_type AS k, count(*) AS f FROM part WHERE p_size % 2 = 1 GROUP BY 1)
SELECT count(*) FILTER (WHERE coalesce(e, 0) = coalesce(f, 0)) AS exact, CAST(sum(greatest(coalesce(e, 0) - coalesce(f, 0), 0)) AS BIGINT) AS missing, CAST(sum(greatest(coalesce(f, 0) - coalesce(e, 0), 0)) AS BIGINT) AS extra FROM t FULL JOIN d USING (k)
""")
def truth_report(t: Tables) -> DataFrame:
    side = lambda r: t.part.where(F.col("p_size") % 2 == r).groupBy(F.col("p_type").alias("k")).agg(F.count(F.lit(1)).alias("quantity"))
    return compared(side(0), side(1), ["k"]).agg(F.count_if(F.col("expected") == F.col("found")).alias("exact"), F.sum("missing").alias("missing"), F.sum("extra").alias("extra"))


@query("""
SELECT p_partkey AS part FROM part WHERE p_name IN ('red gear', 'blue ring') OR regexp_matches(p_brand, '#1[0-4]$') OR (p_size >= 45 AND p_type = 'PROMO')
""")
def tagged_parts(t: Tables) -> DataFrame:
    """A tag by a list of names, patterns or a predicate, whichever fits."""
    names = t.spark.createDataFrame([("red gear",), ("blue ring",)], "p_name string").withColumn("named", F.lit(True))
    rows = t.part.join(F.broadcast(names), "p_name", "left")  # a rule's own list
    p = Predicates(rows)
    hit = F.coalesce("named", F.lit(False)) | p.compile({"p_brand_regex": "#1[0-4]$"}) | p.compile({"all": [{"p_size_gte": 45}, {"p_type_equals": "PROMO"}]})
    return rows.where(hit).select(F.col("p_partkey").alias("part"))


@query("""
SELECT event_id FROM events WHERE event_type = 'signup' OR (event_type IN ('click', 'view') AND value / 50 >= 0.72)
""")
def accepted_reads(t: Tables) -> DataFrame:
    return t.events.where((F.col("event_type") == "signup") | (F.col("event_type").isin("click", "view") & (F.col("value") / 50 >= 0.72))).select("event_id")


@query("""
SELECT c_custkey AS id FROM customer WHERE nullif(c_mktsegment, 'BUILDING') IS NULL OR nullif(c_mktsegment, 'BUILDING') NOT IN ('MACHINERY', 'HOUSEHOLD')
""")
def null_safe_exclusion(t: Tables) -> DataFrame:
    """Excluding values keeps rows whose value is unknown."""
    status = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))
    return t.customer.where(status.isNull() | ~status.isin("MACHINERY", "HOUSEHOLD")).select(F.col("c_custkey").alias("id"))


@query("""
SELECT conv_id, turn, left(text, 120) AS title, try_cast(regexp_extract(text, '[0-9]+', 0) AS INTEGER) AS n FROM conversations WHERE role = 'user'
""")
def clean_summaries(t: Tables) -> DataFrame:
    """Whitelisted keys of a document, typed and cut to length."""
    body = F.to_json(F.struct(F.col("text").alias("title"), F.regexp_extract("text", "[0-9]+", 0).alias("n"), F.lit("x").alias("other")))
    row = F.from_json(body, "title string, n string")
    return t.conversations.where("role = 'user'").select("conv_id", "turn", F.left(row["title"], F.lit(120)).alias("title"), row["n"].try_cast("int").alias("n"))


@query("""
SELECT 'big' AS bucket, count(*) AS n FROM part WHERE p_size > 40 UNION ALL SELECT 'promo', count(*) FROM part WHERE p_type = 'PROMO' UNION ALL SELECT 'cheap', count(*) FROM part WHERE p_retailprice < 950
""")
def named_buckets(t: Tables) -> DataFrame:
    """Counts of named predicates, which may overlap, in one pass."""
    named = {"big": F.col("p_size") > 40, "promo": F.col("p_type") == "PROMO", "cheap": F.col("p_retailprice") < 950}
    rows = t.part.agg(F.array(*[F.struct(F.lit(k).alias("bucket"), F.count_if(c).alias("n")) for k, c in named.items()]).alias("x"))
    return rows.select(F.explode("x").alias("x")).select("x.*")


@query("""
SELECT DISTINCT b.p_partkey AS part FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand <> b.p_brand
WHERE a.p_type = 'PROMO' AND NOT EXISTS (SELECT 1 FROM part k WHERE k.p_type = 'PROMO' AND k.p_partkey = b.p_partkey)
""")
def same_art_elsewhere(t: Tables) -> DataFrame:
    """Prints with a known picture in another set that are not known themselves."""
    known = t.part.where("p_type = 'PROMO'")
    a, b = known.alias("a"), t.part.alias("b")
    rows = b.join(a, (F.col("a.p_name") == F.col("b.p_name")) & (F.col("a.p_brand") != F.col("b.p_brand")), "left_semi")
    return rows.join(known.select("p_partkey"), "p_partkey", "left_anti").select(F.col("p_partkey").alias("part"))


@query("""
SELECT l_orderkey AS list, count(*) AS lines FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1
""")
def cascading_delete(t: Tables) -> DataFrame:
    """The lines that stay when lists go with their lines."""
    gone = t.orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t.lineitem.join(gone, "l_orderkey", "left_anti").groupBy(F.col("l_orderkey").alias("list")).agg(F.count(F.lit(1)).alias("lines"))


@query("""
WITH d AS (SELECT l_partkey AS item, l_returnflag AS finish, count(*) AS detected FROM lineitem WHERE l_linestatus = 'O' AND l_partkey % 3 > 0 GROUP BY 1, 2),
l AS (SELECT l_partkey AS item, l_returnflag AS finish, count(*) AS held, max(l_suppkey % 5 = 0) AS manual FROM lineitem WHERE l_linestatus = 'F' AND l_partkey % 4 > 0 GROUP BY 1, 2)
SELECT coalesce(d.item, l.item) AS item, coalesce(d.finish, l.finish) AS finish, coalesce(detected, 0) AS detected,
  CASE WHEN d.item IS NULL AND manual THEN 'kept' WHEN d.item IS NULL THEN 'deleted' WHEN l.item IS NULL THEN 'new' ELSE 'updated' END AS change
FROM d FULL JOIN l ON d.item = l.item AND d.finish = l.finish
""")
def rebuilt_lines(t: Tables) -> DataFrame:
    """List lines after a scan: new, updated, deleted, or kept because they were entered by hand."""
    keys = [F.col("l_partkey").alias("item"), F.col("l_returnflag").alias("finish")]
    d = t.lineitem.where("l_linestatus = 'O' and l_partkey % 3 > 0").groupBy(*keys).agg(F.count(F.lit(1)).alias("detected"))
    held = t.lineitem.where("l_linestatus = 'F' and l_partkey % 4 > 0").groupBy(*keys).agg(F.max(F.col("l_suppkey") % 5 == 0).alias("manual"))
    rows = d.join(held, ["item", "finish"], "full_outer")
    change = F.when(F.col("detected").isNull() & F.col("manual"), "kept").when(F.col("detected").isNull(), "deleted").when(F.col("manual").isNull(), "new").otherwise("updated")
    return rows.select("item", "finish", F.coalesce("detected", F.lit(0).cast("long")).alias("detected"), change.alias("change"))


@query("""
SELECT l_orderkey AS list, to_json(list({'part': l_partkey, 'q': CAST(l_quantity AS INTEGER)} ORDER BY l_partkey, CAST(l_quantity AS INTEGER)))::VARCHAR AS version FROM lineitem GROUP BY 1
""")
def list_snapshots(t: Tables) -> DataFrame:
    """An immutable version of each list as JSON."""
    rows = F.sort_array(F.collect_list(F.struct(F.col("l_partkey").alias("part"), F.col("l_quantity").cast("int").alias("q"))))
    return t.lineitem.groupBy(F.col("l_orderkey").alias("list")).agg(F.to_json(rows).alias("version"))


@query("""
WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY 1)
SELECT event_type, v[least(CAST(floor(0.9 * len(v)) AS INTEGER), len(v) - 1) + 1] AS p90 FROM s
""")
def floor_percentiles(t: Tables) -> DataFrame:
    return order_statistic(t.events, ["event_type"], "value", 0.9, "p90")


@query("""
SELECT user_id AS capture, event_id AS frame, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 3
""")
def best_frames(t: Tables) -> DataFrame:
    """The three best frames of each group."""
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return t.events.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 3").select(F.col("user_id").alias("capture"), F.col("event_id").alias("frame"), "rank")


@query("""
SELECT CASE WHEN value < 5 THEN 'hash' WHEN event_id % 4 = 0 THEN 'verified' WHEN props LIKE '%9%' THEN 'model' ELSE 'unresolved' END AS stage, count(*) AS n FROM events GROUP BY 1
""")
def identification_stages(t: Tables) -> DataFrame:
    """Cheap tests first; each later stage sees only what is left."""
    left, parts = t.events, []
    for name, accept in (("hash", F.col("value") < 5), ("verified", F.col("event_id") % 4 == 0), ("model", F.col("props").contains("9"))):
        parts.append(left.where(accept).select(F.lit(name).alias("stage")))
        left = left.where(~accept)
    out = left.select(F.lit("unresolved").alias("stage"))
    for p in parts:
        out = out.unionByName(p)
    return out.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))
