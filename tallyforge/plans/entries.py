"""Catalogue files read and flattened, texts and JSON formatted, filters and projections, and measures of quads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import angle, area, box_overlap, centre, width
from ..functions.quality import frontalness, near_codes, quality_score
from ..functions.text import dotted, message, url_text
from ..operators.tables import shared_folder
from ..sources.catalog import copied, flattened, names, read_json_lines, sets_from_json
from .registry import Tables, query


def card_dump(t: Tables) -> str:
    """A dump of parts as nested JSON: one array, an object a line, some with faces; returns its path."""
    size, name = F.col("p_size"), F.col("p_name")
    face = lambda k: F.struct(F.concat(name, F.lit(f" {k}")).alias("name"), F.concat(F.col("p_type"), F.lit(f" {k}")).alias("type_line"), F.when(size % 5 != k, F.concat(F.lit("text "), name)).alias("oracle_text"))
    two = size % 3 == 0
    card = F.struct(
        F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("id"), F.when(size % 4 > 0, F.col("p_brand")).alias("oracle_id"), F.lit("en").alias("lang"), name.alias("name"),
        F.when(size % 11 == 0, "token").when(size % 11 == 1, "art_series").when(size % 11 == 2, "planar").otherwise("normal").alias("layout"), F.lower("p_brand").alias("set"),
        F.when(size % 13 == 0, "memorabilia").otherwise("core").alias("set_type"), size.cast("string").alias("collector_number"), F.lit("2024-02-30").alias("released_at"),
        F.when(~two, F.concat(F.when(size % 7 == 0, "Emblem ").otherwise(""), F.col("p_type"))).alias("type_line"), F.when(two, F.array(face(0), face(1))).alias("card_faces"),
    )
    path = f"{shared_folder(t.spark)}/cards-{uuid.uuid4().hex}"
    lines = t.part.select(F.concat(F.to_json(card), F.lit(",")).alias("value"))
    t.spark.createDataFrame([("[",), ("",), ("]",)], "value string").unionByName(lines).write.text(path)
    return path


CARDS = """
WITH c AS (SELECT 'c' || p_partkey AS id, CASE WHEN p_size % 4 > 0 THEN p_brand ELSE 'c' || p_partkey END AS oracle_id, p_name, p_size, p_size % 3 = 0 AS two, p_type,
  CASE WHEN p_size % 7 = 0 THEN 'Emblem ' ELSE '' END || p_type AS one_type FROM part),
f AS (SELECT *, CASE WHEN two THEN p_name || ' 0' ELSE p_name END AS front_name, CASE WHEN two THEN p_type || ' 0 // ' || p_type || ' 1' ELSE one_type END AS type_line,
  CASE WHEN two THEN nullif(concat_ws(chr(10) || '//' || chr(10), CASE WHEN p_size % 5 <> 0 THEN 'text ' || p_name END, CASE WHEN p_size % 5 <> 1 THEN 'text ' || p_name END), '') END AS oracle_text FROM c)
"""


@query(CARDS + """
SELECT id, oracle_id, front_name, type_line, oracle_text, CASE WHEN p_size % 11 = 0 OR lower(type_line) LIKE 'token%' THEN 'token' WHEN lower(type_line) LIKE 'emblem%' THEN 'emblem' WHEN p_size % 11 = 1 THEN 'art_series'
  WHEN p_size % 11 = 2 OR p_size % 13 = 0 THEN 'other' ELSE 'card' END AS kind FROM f
""")
def catalog_from_json(t: Tables) -> DataFrame:
    """A nested dump read line by line and flattened: faces stand in for what a card lacks, and each row gets its kind."""
    return flattened(read_json_lines(t.spark, card_dump(t))).select("id", "oracle_id", "front_name", "type_line", "oracle_text", "kind")


@query(CARDS + "SELECT DISTINCT oracle_id, unnest([p_name, front_name]) AS name FROM f")
def names_from_json(t: Tables) -> DataFrame:
    return names(flattened(read_json_lines(t.spark, card_dump(t)))).select("oracle_id", "name")


@query("""
WITH r AS (SELECT n_nationkey AS k, 's' || n_nationkey % 7 AS code, n_name AS name FROM nation)
SELECT code, arg_max(name, k) AS name, CAST(max(k) AS INTEGER) AS card_count FROM r GROUP BY 1
""")
def sets_upserted(t: Tables) -> DataFrame:
    """One JSON answer of sets; a code that comes again keeps its last row."""
    row = F.struct(F.concat(F.lit("s"), (F.col("n_nationkey") % 7).cast("string")).alias("code"), F.col("n_name").alias("name"), F.lit("core").alias("set_type"), F.col("n_nationkey").cast("int").alias("card_count"))
    held = F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", row.alias("x")))), lambda y: y["x"])
    path = f"{shared_folder(t.spark)}/sets-{uuid.uuid4().hex}"
    t.nation.agg(F.to_json(F.struct(held.alias("data"))).alias("value")).write.text(path)
    return sets_from_json(t.spark, path).select("code", "name", "card_count")


@query("SELECT o_orderkey, o_custkey, CAST(NULL AS DOUBLE) AS o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus = 'F'")
def store_copy(t: Tables) -> DataFrame:
    """Rows for another store, one column emptied."""
    return copied(t.orders, ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"], ("o_totalprice",), F.col("o_orderstatus") == "F")


@query("""
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'Order {n} waits for {whom}' ELSE 'Order ' || o_orderkey || ' of ' || o_custkey || ' is ' || o_orderstatus || '!' END AS text FROM orders
""")
def messages(t: Tables) -> DataFrame:
    """Templates filled in; one that names an unknown value stays as it is."""
    values = {"n": F.col("o_orderkey"), "customer": F.col("o_custkey"), "status": F.col("o_orderstatus")}
    text = F.when(F.col("o_orderkey") % 3 == 0, message("Order {n} waits for {whom}", values)).otherwise(message("Order {n} of {customer} is {status}!", values))
    return t.orders.select(F.col("o_orderkey").alias("id"), text.alias("text"))


@query("SELECT doc_id, url_encode(text) AS url FROM documents")
def urls_encoded(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", url_text(F.col("text")).alias("url"))


@query("""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_id % 5 AS deep, '{"a":{"b":' || event_id % 5 || '},"t":"' || event_type || '"}' AS encoded FROM events
""")
def json_dotted(t: Tables) -> DataFrame:
    """JSON written, and values read at dotted paths."""
    encoded = F.to_json(F.struct(F.struct((F.col("event_id") % 5).alias("b")).alias("a"), F.col("event_type").alias("t")))
    return t.events.withColumn("encoded", encoded).select("event_id", dotted(F.col("props"), "k").cast("int").alias("k"), dotted(F.col("encoded"), "a.b").cast("long").alias("deep"), "encoded")


@query("""
WITH x AS (SELECT p_partkey AS item, p_size AS print FROM part UNION ALL SELECT l_partkey, 100 + l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 12)
SELECT item, count(*) AS entries, CAST(max(print) AS INTEGER) AS newest FROM x GROUP BY 1
""")
def index_with_corrections(t: Tables) -> DataFrame:
    """Corrections (returned lines) join the index, but for flat pictures (a deviation under 12)."""
    learned = t.lineitem.where((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 12)).select(F.col("l_partkey").alias("item"), (100 + F.col("l_linenumber")).cast("int").alias("print"))
    index = t.part.select(F.col("p_partkey").alias("item"), F.col("p_size").cast("int").alias("print")).unionByName(learned)
    return index.groupBy("item").agg(F.count(F.lit(1)).alias("entries"), F.max("print").alias("newest"))


@query("SELECT o_orderkey AS id, o_orderdate AS at FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def rows_of_ids(t: Tables) -> DataFrame:
    """Rows whose id another table names: a semi-join, however many ids there are."""
    return t.orders.join(t.customer.where("c_acctbal < 0"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))


@query("SELECT event_id, event_type, value FROM events WHERE user_id = 7")
def rows_of_owner(t: Tables) -> DataFrame:
    return t.events.where("user_id = 7").select("event_id", "event_type", "value")


@query("SELECT event_id, event_type AS kind, CAST(round(value, 1) AS DOUBLE) AS value FROM events")
def public_rows(t: Tables) -> DataFrame:
    """What others may see: no owner, no details."""
    return t.events.drop("user_id", "props", "ts").select("event_id", F.col("event_type").alias("kind"), F.round("value", 1).alias("value"))


@query("""
SELECT event_id AS id, user_id AS owner, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END, event_id) AS nth FROM events
""")
def issues_by_severity(t: Tables) -> DataFrame:
    """Errors first, then warnings, then notes; equal ones keep their order."""
    severity = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "signup", 1).otherwise(2)
    return t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("owner"), F.row_number().over(Window.partitionBy("user_id").orderBy(severity, "event_id")).cast("long").alias("nth"))


@query("SELECT o_orderkey AS id, o_orderdate AS at FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def latest_lists(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at")).orderBy(F.desc("at"), "id").limit(50)


@query("""
WITH e AS (SELECT user_id, event_id, event_type, ts, CAST(floor(value) AS BIGINT) % 1024 AS bits FROM events)
SELECT a.event_id AS first, b.event_id AS again FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.ts < b.ts AND epoch_us(b.ts) - epoch_us(a.ts) <= 3600000000 AND bit_count(xor(a.bits, b.bits)) <= 4
""")
def shown_again(t: Tables) -> DataFrame:
    """The same thing shown again within an hour: rows meet in hour bins, so no owner's rows are all paired."""
    bits = (F.floor("value") % 1024).alias("bits")
    e = t.events.select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), bits).withColumn("hour", F.floor(F.col("at") / 3_600_000_000))
    b = e.select("user_id", "event_type", F.col("event_id").alias("again"), F.col("at").alias("then"), F.col("bits").alias("other"), F.explode(F.array("hour", F.col("hour") - 1)).alias("hour"))
    met = e.join(b, ["user_id", "event_type", "hour"]).where((F.col("at") < F.col("then")) & (F.col("then") - F.col("at") <= 3_600_000_000) & (F.bit_count(F.col("bits").bitwiseXOR(F.col("other"))) <= 4))
    return met.select(F.col("event_id").alias("first"), "again")


QUADS = """
WITH q AS (SELECT l_orderkey * 10 + l_linenumber AS id, min(CAST(l_partkey % 50 AS DOUBLE)) AS x, min(CAST(l_suppkey % 30 AS DOUBLE)) AS y, min(10 + CAST(l_quantity AS DOUBLE)) AS w, min(20 + CAST(l_linenumber AS DOUBLE)) AS h FROM lineitem GROUP BY 1)
"""


def quads(t: Tables) -> DataFrame:
    part = lambda c: F.min(c.cast("double"))
    q = t.lineitem.groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).agg(part(F.col("l_partkey") % 50).alias("x"), part(F.col("l_suppkey") % 30).alias("y"), part(10 + F.col("l_quantity")).alias("w"), part(20 + F.col("l_linenumber")).alias("h"))
    x, y, w, h = (F.col(c) for c in "xywh")
    return q.withColumn("quad", F.array(F.array(x, y), F.array(x + w, y + 1), F.array(x + w, y + h), F.array(x, y + h)))


@query(QUADS + """
SELECT id, round((w * (h - 1) + w * h) / 2, 6) AS area, round((x + x + w + x + w + x) / 4, 6) AS cx, round((sqrt(w * w + 1) + w) / 2, 6) AS width, round(degrees(atan2(1, w)), 6) AS angle,
  round(CASE WHEN greatest(0, w - 5) * h > 0 THEN greatest(0, w - 5) * h / (2 * w * h - greatest(0, w - 5) * h) ELSE 0 END, 6) AS overlap FROM q
""")
def quad_measures(t: Tables) -> DataFrame:
    moved = F.transform("quad", lambda p: F.array(p[0] + 5, p[1]))
    q = F.col("quad")
    return quads(t).select("id", F.round(area(q), 6).alias("area"), F.round(centre(q)[0], 6).alias("cx"), F.round(width(q), 6).alias("width"), F.round(angle(q), 6).alias("angle"), F.round(box_overlap(q, moved), 6).alias("overlap"))


@query(QUADS + """
, f AS (SELECT *, (w * (h - 1) + w * h) / 2 / (w * h) AS front FROM q)
SELECT id, round(front, 6) AS frontalness, round(0.5 * least(1, greatest(0, (log10(1 + x * 30) - 1) / 2)) + 0.2 * (1 - least(1, y / 30)) + 0.3 * front, 6) AS quality FROM f
""")
def frame_quality(t: Tables) -> DataFrame:
    """Sharp, free of glare and seen from the front."""
    q = F.col("quad")
    return quads(t).select("id", F.round(frontalness(q), 6).alias("frontalness"), F.round(quality_score(1 + F.col("x") * 30, F.col("y") / 30, q), 6).alias("quality"))


@query("""
WITH c AS (SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'plst' WHEN 1 THEN 'p' || lower(p_type) ELSE lower(p_type) END AS a, lower(p_type) AS b, CASE p_size % 3 WHEN 0 THEN 'promo' ELSE lower(p_type) END AS other FROM part)
SELECT id, a = b OR a = 'p' || b OR b = 'p' || a OR a = 'plst' OR b = 'plst' AS near, a = other OR a = 'p' || other OR other = 'p' || a OR a = 'plst' OR other = 'plst' AS near_other FROM c
""")
def near_set_codes(t: Tables) -> DataFrame:
    b = F.lower("p_type")
    a = F.when(F.col("p_size") % 4 == 0, "plst").when(F.col("p_size") % 4 == 1, F.concat(F.lit("p"), b)).otherwise(b)
    other = F.when(F.col("p_size") % 3 == 0, "promo").otherwise(b)
    return t.part.select(F.col("p_partkey").alias("id"), near_codes(a, b).alias("near"), near_codes(a, other).alias("near_other"))
