"""Listings in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fixed, money_text, name_norm
from ..operators.contest import standings
from ..sources.listing import csv_line, export_line, one_text, parsed_listing, player_names
from .contests import MATCHES, matches
from .registry import Tables, query

LISTED = """
WITH r AS (SELECT l_orderkey AS list, l_linenumber AS line_no, p_name AS name, CAST(l_quantity AS INTEGER) AS q, p_brand, p_size, l_returnflag,
  row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem JOIN part ON p_partkey = l_partkey),
u AS (SELECT * FROM r WHERE k = 1)
"""


def listed(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    first = F.min_by(F.struct("p_name", "l_quantity", "p_brand", "p_size", "l_returnflag"), F.struct("l_partkey", "l_suppkey", "l_extendedprice"))
    # lines of a list come together once, for this and for what a reader does with whole lists
    return rows.repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("list"), F.col("l_linenumber").alias("line_no")).agg(first.alias("x")).select("list", "line_no", "x.*").withColumn("l_quantity", F.col("l_quantity").cast("int"))


@query(LISTED + """
, v AS (SELECT *, max(CASE WHEN line_no = 4 THEN 1 ELSE 0 END) OVER (PARTITION BY list ORDER BY line_no) AS below FROM u)
SELECT list, line_no, CASE WHEN line_no = 2 AND p_size % 5 = 0 THEN 'commander' WHEN below = 1 THEN 'sideboard' ELSE 'deck' END AS zone,
  CASE WHEN line_no = 3 THEN 1 ELSE q END AS quantity, CASE p_size % 4 WHEN 0 THEN 'x' || name WHEN 1 THEN '2nd ' || name ELSE name END AS name,
  's' || p_size || 'x' AS set_code, CASE WHEN p_size > 25 THEN p_size::VARCHAR END AS collector_number,
  CASE l_returnflag WHEN 'R' THEN 'foil' WHEN 'A' THEN 'etched' ELSE 'nonfoil' END AS finish FROM v WHERE line_no NOT IN (4, 6)
""")
def parse_listing(t: Tables) -> DataFrame:
    """Lines written and read back; line 4 of each list is the header of its sideboard, line 6 a comment.

    Some names open with a digit or an x, line 3 has no count, and marks name colours, tags and the commander.
    """
    rows, size, line_no = listed(t), F.col("p_size"), F.col("line_no")
    code = F.concat(F.lit("S"), size.cast("string"), F.lit("X"))
    count = F.when(line_no == 3, F.lit(None)).when(size % 3 == 0, F.col("l_quantity").cast("string")).otherwise(F.concat(F.col("l_quantity").cast("string"), F.lit("x")))
    name = F.concat(F.when(size % 4 == 0, "x").when(size % 4 == 1, "2nd ").otherwise(""), F.col("p_name"))
    marks = [F.when(F.col("l_returnflag") == "R", "*F*").when(F.col("l_returnflag") == "A", "*E*"), F.when((line_no == 2) & (size % 5 == 0), "[Commander{top}]"), F.when(size % 7 == 0, "^Have,#37d67a^")]
    bracketed = F.when((size % 2 == 0), F.concat(F.lit("("), code, F.lit(")"))).otherwise(F.concat(F.lit("["), code, F.lit("]")))
    line = F.concat_ws(" ", count, name, bracketed, F.when(size > 25, size.cast("string")), *marks)
    raw = F.when(line_no == 4, F.when(size % 2 == 0, "// Sideboard").otherwise("Companion:")).when(line_no == 6, "# a comment").otherwise(line)
    return parsed_listing(rows.select("list", "line_no", raw.alias("raw")), ["list"]).drop("is_commander")


@query(LISTED + """
SELECT list, string_agg(q || ' ' || name || ' (' || upper(p_brand) || ') ' || p_size || CASE l_returnflag WHEN 'R' THEN ' *F*' WHEN 'A' THEN ' *E*' ELSE '' END, chr(10) ORDER BY line_no) AS text FROM u GROUP BY list
""")
def export_lines(t: Tables) -> DataFrame:
    finish = F.when(F.col("l_returnflag") == "R", "foil").when(F.col("l_returnflag") == "A", "etched").otherwise("nonfoil")
    line = export_line("marked", F.col("l_quantity"), F.col("p_name"), F.col("p_brand"), F.col("p_size").cast("string"), finish)
    return one_text(listed(t).withColumn("line", line), ["list"], ["line_no"], "line")


@query(LISTED + """
SELECT list, line_no, q || ',' || CASE WHEN p_size % 2 = 0 THEN chr(34) || name || ', ' || repeat(chr(34), 2) || p_brand || repeat(chr(34), 3) ELSE name END || ',' || CASE WHEN p_size > 40 THEN '' ELSE p_size::VARCHAR END AS row FROM u
""")
def export_csv_rows(t: Tables) -> DataFrame:
    name = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"'))).otherwise(F.col("p_name"))
    return listed(t).select("list", "line_no", csv_line(F.col("l_quantity"), name, F.when(F.col("p_size") <= 40, F.col("p_size"))).alias("row"))


@query(MATCHES + """
SELECT contest, string_agg(rank || ',' || player || ',' || points || ',' || CAST(floor(round(omw, 9) * 10000 + 0.5::DOUBLE) AS BIGINT) // 10000 || '.' || lpad((CAST(floor(round(omw, 9) * 10000 + 0.5::DOUBLE) AS BIGINT) % 10000)::VARCHAR, 4, '0'), chr(10) ORDER BY rank) AS text FROM x GROUP BY contest
""")
def contest_export(t: Tables) -> DataFrame:
    s = standings(matches(t))
    row = csv_line(F.col("rank"), F.col("player"), F.col("points").cast("long"), fixed(F.col("omw"), 4))
    return one_text(s.withColumn("row", row), ["contest"], ["rank"], "row")


@query(r"""
WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM conversations),
n AS (SELECT conv_id, turn, pos, trim(regexp_replace(raw, '^\s*(?:\d+[.)-]?|[-*•])?\s*', '')) AS name FROM l),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(name) ORDER BY turn, pos) AS k FROM n WHERE name <> '')
SELECT conv_id AS list, count(*) AS lines, min(name) AS first FROM k WHERE k = 1 GROUP BY 1
""")
def player_list(t: Tables) -> DataFrame:
    """Names of a list, the first of each spelling."""
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    texts = t.conversations.groupBy(F.col("conv_id").alias("list")).agg(whole.alias("text"))
    return player_names(texts, ["list"], "text").groupBy("list").agg(F.count(F.lit(1)).alias("lines"), F.min("name").alias("first"))


@query("""
SELECT c_custkey AS id, 'R$ ' || replace(replace(replace(format('{:,.2f}', c_acctbal), ',', '#'), '.', ','), '#', '.') AS balance FROM customer
""")
def money_texts(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("id"), money_text(F.col("c_acctbal")).alias("balance"))


@query(r"""
SELECT doc_id, array_to_string(regexp_extract_all(lower(regexp_replace(strip_accents(regexp_replace(text, '\p{Z}', ' ', 'g')), '[^\x00-\x7F]', '', 'g')), '[a-z0-9_]+'), ' ') AS norm FROM documents
""")
def normalised_texts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", name_norm(F.col("text")).alias("norm"))
