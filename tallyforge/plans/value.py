"""Valuation queries. Holdings are line items; parts are the price list, with gaps in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import FALLBACK_RATE, export_price
from ..operators.valuation import at_rate, totals, with_prices
from .registry import Tables, query


def prices(t: Tables) -> DataFrame:
    p, size = F.col("p_retailprice").cast("string"), F.col("p_size")
    return t.part.select(
        F.col("p_partkey").alias("part"), "p_brand", "p_name", "p_type",
        F.when(size % 5 == 0, F.lit(" ")).otherwise(p).alias("usd"),
        F.when(size % 3 == 0, (F.col("p_retailprice") * 2).cast("string")).alias("usd_foil"),
        F.when(size % 7 == 0, F.lit("n/a")).when(size % 2 == 0, (F.col("p_retailprice") + 1).cast("string")).alias("usd_etched"),
    )


def holdings(t: Tables) -> DataFrame:
    finish = F.when(F.col("l_returnflag") == "A", "foil").when(F.col("l_returnflag") == "R", "etched").otherwise("nonfoil")
    return t.lineitem.select(F.col("l_partkey").alias("part"), finish.alias("finish"), F.col("l_quantity").cast("long").alias("quantity"))


PRICED = """
WITH price AS (
  SELECT p_partkey AS part, p_brand, p_name, p_type,
    CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_retailprice END AS usd,
    CASE WHEN p_size % 3 = 0 THEN p_retailprice * 2 END AS usd_foil,
    CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 2 = 0 THEN p_retailprice + 1 END AS usd_etched
  FROM part
), held AS (
  SELECT l_partkey AS part, CAST(l_quantity AS BIGINT) AS quantity,
    CASE l_returnflag WHEN 'A' THEN 'foil' WHEN 'R' THEN 'etched' ELSE 'nonfoil' END AS finish
  FROM lineitem
), priced AS (
  SELECT h.*, p_brand, p_name, p_type, usd, usd_foil, usd_etched,
    coalesce(CASE finish WHEN 'foil' THEN usd_foil WHEN 'etched' THEN usd_etched END, usd, usd_foil) AS unit_usd
  FROM held h LEFT JOIN price USING (part)
)
"""


@query(PRICED + """
SELECT p_brand AS brand, round(sum(unit_usd * quantity * 5.40), 2) AS total, count(unit_usd) AS priced_rows,
  CAST(coalesce(sum(CASE WHEN unit_usd IS NULL THEN quantity END), 0) AS BIGINT) AS unpriced_quantity
FROM priced GROUP BY 1 ORDER BY total DESC, brand
""")
def valuation_by_group(t: Tables) -> DataFrame:
    rows = with_prices(holdings(t), prices(t), "part")
    return totals(rows.withColumnRenamed("p_brand", "brand"), ["brand"], F.lit(FALLBACK_RATE)).orderBy(F.desc("total"), "brand")


@query(PRICED + """
SELECT part, finish, round(any_value(unit_usd) * 5.40, 2) AS unit, CAST(sum(quantity) AS BIGINT) AS quantity,
  round(any_value(unit_usd) * 5.40 * sum(quantity), 2) AS total
FROM priced WHERE unit_usd IS NOT NULL GROUP BY part, finish ORDER BY any_value(unit_usd) DESC, part, finish LIMIT 10
""")
def valuation_top_items(t: Tables) -> DataFrame:
    rows = with_prices(holdings(t), prices(t), "part").where("unit_usd is not null")
    rows = rows.groupBy("part", "finish").agg(F.max("unit_usd").alias("usd"), F.sum("quantity").alias("quantity"))
    best = rows.orderBy(F.desc("usd"), "part", "finish").limit(10)
    unit = F.col("usd") * FALLBACK_RATE
    return best.select("part", "finish", F.round(unit, 2).alias("unit"), "quantity", F.round(unit * F.col("quantity"), 2).alias("total"))


@query(PRICED + """
SELECT part, p_name AS name, round(max(unit_usd) * 5.40, 2) AS unit
FROM priced WHERE unit_usd * 5.40 >= 5000 GROUP BY part, p_name ORDER BY max(unit_usd) DESC, part LIMIT 12
""")
def valuable_finds(t: Tables) -> DataFrame:
    rows = with_prices(holdings(t), prices(t), "part").where(F.col("unit_usd") * FALLBACK_RATE >= 5000)
    best = rows.groupBy("part", F.col("p_name").alias("name")).agg(F.max("unit_usd").alias("usd")).orderBy(F.desc("usd"), "part").limit(12)
    return best.select("part", "name", F.round(F.col("usd") * FALLBACK_RATE, 2).alias("unit"))


@query(PRICED + """
SELECT finish, count(*) AS lines, count(own) AS own_priced, round(sum(coalesce(own, usd)), 2) AS sum_unit
FROM (SELECT *, CASE finish WHEN 'foil' THEN usd_foil WHEN 'etched' THEN usd_etched END AS own FROM priced) GROUP BY finish
""")
def export_prices(t: Tables) -> DataFrame:
    rows = with_prices(holdings(t), prices(t), "part")
    own = export_price(F.col("finish"), F.lit(None).cast("string"), F.col("usd_foil"), F.col("usd_etched"))
    unit = export_price(F.col("finish"), F.col("usd"), F.col("usd_foil"), F.col("usd_etched"))
    return rows.groupBy("finish").agg(F.count(F.lit(1)).alias("lines"), F.count(own).alias("own_priced"), F.round(F.sum(unit), 2).alias("sum_unit"))


@query(PRICED + """
, per AS (SELECT part, finish, round(any_value(unit_usd), 2) AS unit, sum(quantity) AS n FROM priced GROUP BY part, finish)
SELECT part, round(sum(unit * n), 2) AS row_value, CAST(sum(n) AS BIGINT) AS copies FROM per GROUP BY part
""")
def row_values(t: Tables) -> DataFrame:
    """Unit prices are rounded before a row's value is summed, unlike in the totals."""
    rows = with_prices(holdings(t), prices(t), "part").groupBy("part", "finish").agg(F.round(F.max("unit_usd"), 2).alias("unit"), F.sum("quantity").alias("n"))
    return rows.groupBy("part").agg(F.round(F.sum(F.col("unit") * F.col("n")), 2).alias("row_value"), F.sum("n").alias("copies"))


@query("""
WITH q AS (
  SELECT CAST(CAST(ts AS DATE) - 8400 AS DATE) AS quoted_on, 5 + avg(value) / 100 AS rate
  FROM events WHERE event_type = 'purchase' AND day(ts) % 6 < 2 GROUP BY 1
), o AS (SELECT CAST(o_orderdate AS DATE) AS day, o_totalprice FROM orders), j AS (
  SELECT o.day, o_totalprice, CASE WHEN q.quoted_on >= o.day - 10 THEN q.rate END AS rate
  FROM o ASOF LEFT JOIN q ON o.day >= q.quoted_on
)
SELECT strftime(day, '%Y-%m') AS month, round(sum(o_totalprice * coalesce(rate, 5.40)), 2) AS total,
  count(rate) AS quoted, count(*) - count(rate) AS fallback
FROM j GROUP BY 1
""")
def fx_asof_valuation(t: Tables) -> DataFrame:
    """Orders at the latest quote of the ten days before, or the fallback rate."""
    bought = t.events.where((F.col("event_type") == "purchase") & (F.dayofmonth("ts") % 6 < 2))
    quotes = bought.groupBy(F.date_sub(F.to_date("ts"), 8400).alias("quoted_on")).agg((5 + F.avg("value") / 100).alias("rate"))
    rows = at_rate(t.orders.select(F.to_date("o_orderdate").alias("day"), "o_totalprice"), "day", quotes, fallback=-1.0)
    known = F.col("rate") > 0
    return rows.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(
        F.round(F.sum(F.col("o_totalprice") * F.when(known, F.col("rate")).otherwise(FALLBACK_RATE)), 2).alias("total"),
        F.count_if(known).alias("quoted"), F.count_if(~known).alias("fallback"),
    )


@query("""
WITH api AS (
  SELECT user_id, arg_max(value, event_id) AS v FROM events WHERE event_type = 'view' GROUP BY 1
), cache AS (
  SELECT user_id, arg_max(value, event_id) AS v FROM events WHERE event_type = 'click' AND ts > TIMESTAMP '2024-01-20' GROUP BY 1
), u AS (SELECT DISTINCT user_id FROM events)
SELECT u.user_id, coalesce(cache.v, api.v, 0) AS price,
  CASE WHEN cache.v IS NOT NULL THEN 'cache' WHEN api.v IS NOT NULL THEN 'api' ELSE 'catalog' END AS origin
FROM u LEFT JOIN cache USING (user_id) LEFT JOIN api USING (user_id)
""")
def price_cascade(t: Tables) -> DataFrame:
    """A fresh cached price, else the service's, else the catalogue's, with where it came from."""
    cached = t.events.where((F.col("event_type") == "click") & (F.col("ts") > F.to_timestamp_ntz(F.lit("2024-01-20 00:00:00")))).groupBy("user_id").agg(F.max_by("value", "event_id").alias("cached"))
    service = t.events.where("event_type = 'view'").groupBy("user_id").agg(F.max_by("value", "event_id").alias("service"))
    rows = t.events.select("user_id").distinct().join(cached, "user_id", "left").join(service, "user_id", "left")
    origin = F.when(F.col("cached").isNotNull(), "cache").when(F.col("service").isNotNull(), "api").otherwise("catalog")
    return rows.select("user_id", F.coalesce("cached", "service", F.lit(0.0)).alias("price"), origin.alias("origin"))
