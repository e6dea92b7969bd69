"""Search and lookup queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import collector_number, name_norm, word_number
from ..operators.rank import best_per_key
from ..operators.search import bm25, match_class, resolve_in_stages, token_matches, trigram_similarity
from .registry import Tables, query


@query("""
WITH hit AS (
  SELECT p_partkey AS part, p_brand AS brand, p_name AS name,
    CASE WHEN p_name = 're gea' THEN 0 WHEN starts_with(p_name, 're') THEN 1 ELSE 2 END AS class, length(p_name) AS n
  FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda w: starts_with(w, 're'))) > 0
    AND len(list_filter(string_split(p_name, ' '), lambda w: starts_with(w, 'gea'))) > 0
), best AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY class, n, part) AS r FROM hit)
SELECT part, brand, name FROM best WHERE r = 1 ORDER BY class, n, part LIMIT 20
""")
def search_prefix_tokens(t: Tables) -> DataFrame:
    """Prefix search, best of each item, then the best overall."""
    hits = token_matches(t.part, "p_name", "re gea").withColumn("class", match_class(name_norm(F.col("p_name")), "re"))
    best = best_per_key(hits, ["p_brand"], [F.col("class"), F.length("p_name"), F.col("p_partkey")])
    best = best.orderBy("class", F.length("p_name"), "p_partkey").limit(20)
    return best.select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("brand"), F.col("p_name").alias("name"))


@query("""
SELECT count(*) AS hits, min(p_partkey) AS first FROM part
WHERE len(list_filter(string_split(p_name, ' '), lambda w: contains(w, 'idge'))) > 0
""")
def search_substring_tokens(t: Tables) -> DataFrame:
    return token_matches(t.part, "p_name", "idge", prefix=False).agg(F.count(F.lit(1)).alias("hits"), F.min("p_partkey").alias("first"))


@query("""
WITH g AS (
  SELECT DISTINCT p_name AS name, list_distinct(list_transform(range(1, length('  ' || p_name || ' ') - 1), lambda i: substr('  ' || p_name || ' ', i, 3))) AS a,
    list_distinct(list_transform(range(1, length('  red gear ') - 1), lambda i: substr('  red gear ', i, 3))) AS b FROM part
)
SELECT name, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) AS similarity FROM g
ORDER BY similarity DESC, name LIMIT 15
""")
def search_trigram(t: Tables) -> DataFrame:
    names = t.part.select(F.col("p_name").alias("name")).distinct()
    rows = trigram_similarity(names, "name", "red gear").withColumn("similarity", F.round("similarity", 6))
    return rows.orderBy(F.desc("similarity"), "name").limit(15)


@query(r"""
WITH w AS (
  SELECT doc_id AS id, list_filter(regexp_extract_all(lower(regexp_replace(strip_accents(regexp_replace(text, '\p{Z}', ' ', 'g')), '[^\x00-\x7F]', '', 'g')), '[a-z0-9_]+'), lambda x: x <> '') AS words FROM documents
), d AS (SELECT id, len(words) AS length, unnest(words) AS token FROM w), i AS (
  SELECT id, length, token, count(*) AS tf FROM d GROUP BY ALL
), c AS (SELECT count(DISTINCT id) AS docs, (SELECT avg(len(words)) FROM w WHERE len(words) > 0) AS mean FROM d),
h AS (SELECT * FROM i WHERE token IN ('und', 'the', 'thoning', 'que')), f AS (SELECT token, count(*) AS df FROM h GROUP BY 1)
SELECT id, round(-sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS rank
FROM h JOIN f USING (token), c GROUP BY id
""")
def search_bm25(t: Tables) -> DataFrame:
    found = bm25(t.documents, "doc_id", "text", ["und", "the", "thoning", "que"])
    return found.select("id", F.round("rank", 6).alias("rank"))


@query("""
WITH names AS (SELECT p_name AS k, min(p_partkey) AS id FROM part GROUP BY 1),
  typed AS (SELECT p_brand || ':' || p_size AS k, min(p_partkey) AS id FROM part WHERE p_type = 'PROMO' GROUP BY 1),
  any_ AS (SELECT p_brand || ':' || p_size AS k, min(p_partkey) AS id FROM part WHERE p_type <> 'PROMO' AND p_size < 30 GROUP BY 1),
  asked AS (SELECT l_orderkey * 100 + l_linenumber AS line, min('Brand#' || (l_suppkey % 25 + 1) || ':' || (l_partkey % 60)) AS k,
    min(CASE WHEN l_linenumber = 1 THEN 'red gear' WHEN l_linenumber = 2 THEN 'odd name' END) AS n FROM lineitem GROUP BY 1)
SELECT line, coalesce(typed.id, any_.id, names.id) AS id,
  CASE WHEN typed.id IS NOT NULL THEN 'exact' WHEN any_.id IS NOT NULL THEN 'other' WHEN names.id IS NOT NULL THEN 'name' ELSE 'unresolved' END AS method
FROM asked LEFT JOIN typed ON typed.k = asked.k LEFT JOIN any_ ON any_.k = asked.k LEFT JOIN names ON names.k = asked.n
""")
def resolve_cascade(t: Tables) -> DataFrame:
    """Set and number in the asked kind, then in any other, then the name."""
    number = F.concat("p_brand", F.lit(":"), F.col("p_size").cast("string"))
    first = lambda df, key: df.groupBy(key.alias("key")).agg(F.min("p_partkey").alias("id"))
    stages = [("exact", first(t.part.where("p_type = 'PROMO'"), number)), ("other", first(t.part.where("p_type <> 'PROMO' and p_size < 30"), number)), ("name", first(t.part, F.col("p_name")))]
    asked_number = F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 25 + 1).cast("string"), F.lit(":"), (F.col("l_partkey") % 60).cast("string"))
    asked_name = F.when(F.col("l_linenumber") == 1, "red gear").when(F.col("l_linenumber") == 2, "odd name")
    asked = t.lineitem.groupBy((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("line")).agg(F.min(asked_number).alias("exact"), F.min(asked_name).alias("name"))
    return resolve_in_stages(asked.withColumn("other", F.col("exact")), "line", stages)


@query("""
WITH known AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)
SELECT p_brand AS code, n FROM known WHERE n > 40 AND (contains(lower(p_brand), '#1') OR starts_with(lower(p_brand), 'brand#2'))
ORDER BY p_brand <> 'Brand#1', NOT starts_with(p_brand, 'Brand#2'), length(p_brand), n DESC, p_brand LIMIT 10
""")
def search_sets(t: Tables) -> DataFrame:
    """Exact code first, then names that open with the query, shorter and larger sets first."""
    sets = t.part.groupBy(F.col("p_brand").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    low = F.lower("code")
    rows = sets.where((F.col("n") > 40) & (low.contains("#1") | low.startswith("brand#2")))
    return rows.orderBy(F.col("code") != "Brand#1", ~F.col("code").startswith("Brand#2"), F.length("code"), F.desc("n"), "code").limit(10)


@query("""
WITH r AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus,
    'Brand#' || (l_suppkey % 27) AS brand, l_partkey % 2100 AS number FROM lineitem),
brands AS (SELECT DISTINCT p_brand FROM part), flags AS (SELECT l_partkey AS k, max(l_quantity) AS most FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1)
SELECT code, count(*) AS n FROM (
  SELECT CASE WHEN b.p_brand IS NULL THEN 'unknown_set' WHEN p.p_partkey IS NULL THEN 'unknown_number'
    WHEN p.p_brand <> r.brand AND l_quantity > 30 THEN 'name_mismatch' WHEN f.k IS NULL THEN 'language_never_printed'
    WHEN l_quantity > f.most THEN 'finish_never_printed' ELSE 'ok' END AS code
  FROM r LEFT JOIN brands b ON b.p_brand = r.brand LEFT JOIN part p ON p.p_partkey = r.number LEFT JOIN flags f ON f.k = r.number)
GROUP BY code
""")
def impossible_record(t: Tables) -> DataFrame:
    """The first of five codes that tells why a record cannot be right."""
    rows = t.lineitem.select("l_quantity", F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 27).cast("string")).alias("brand"), (F.col("l_partkey") % 2100).alias("number"))
    brands = t.part.select(F.col("p_brand").alias("brand")).distinct().withColumn("known", F.lit(True))
    parts = t.part.select(F.col("p_partkey").alias("number"), "p_brand")
    most = t.lineitem.where("l_returnflag = 'N'").groupBy(F.col("l_partkey").alias("number")).agg(F.max("l_quantity").alias("most"))
    rows = rows.join(brands, "brand", "left").join(parts, "number", "left").join(most, "number", "left")
    code = (
        F.when(F.col("known").isNull(), "unknown_set").when(F.col("p_brand").isNull(), "unknown_number")
        .when((F.col("p_brand") != F.col("brand")) & (F.col("l_quantity") > 30), "name_mismatch")
        .when(F.col("most").isNull(), "language_never_printed").when(F.col("l_quantity") > F.col("most"), "finish_never_printed").otherwise("ok")
    )
    return rows.groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT o_orderstatus AS status, count(*) AS n, count(*) FILTER (WHERE date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-10') < 75) AS recent
FROM orders GROUP BY 1
""")
def catalog_staleness(t: Tables) -> DataFrame:
    day = F.try_to_date(F.left(F.col("o_orderdate").cast("string"), F.lit(10)))
    recent = F.datediff(F.to_date(F.lit("2001-08-10")), day) < 75
    return t.orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_if(recent).alias("recent"))


@query("""
SELECT p_partkey AS part, coalesce(nullif(regexp_extract('00' || p_partkey || 'a/99', '^0*(\\d+)(.*?)/', 1), '') || 'a', '?') AS number,
  CASE p_size % 4 WHEN 0 THEN 9 WHEN 1 THEN 7 WHEN 2 THEN p_size END AS limit_ FROM part
""".replace("\\\\", "\\"))
def numbers_normalised(t: Tables) -> DataFrame:
    asked = F.when(F.col("p_size") % 4 == 0, "nine").when(F.col("p_size") % 4 == 1, "Seven").when(F.col("p_size") % 4 == 2, F.col("p_size").cast("string")).otherwise("many")
    raw = F.concat(F.lit("00"), F.col("p_partkey").cast("string"), F.lit("a/99"))
    return t.part.select(F.col("p_partkey").alias("part"), collector_number(raw).alias("number"), word_number(asked).alias("limit_"))
