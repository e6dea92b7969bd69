"""Valuation of holdings against a price list, with currency rates as of a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import FALLBACK_RATE, priced


def with_prices(holdings: DataFrame, prices: DataFrame, key: str) -> DataFrame:
    """Holdings (key, finish, quantity) with their unit price; ``prices`` has key, usd, usd_foil and usd_etched."""
    return holdings.join(prices, key, "left").withColumn("unit_usd", priced(F.col("finish"), F.col("usd"), F.col("usd_foil"), F.col("usd_etched")))


def totals(rows: DataFrame, keys: list[str], rate: Column) -> DataFrame:
    """Total value, priced rows and unpriced quantity of each group; the total is rounded once, at the end."""
    return rows.groupBy(*keys).agg(
        F.round(F.sum(F.col("unit_usd") * F.col("quantity") * rate), 2).alias("total"),
        F.count("unit_usd").alias("priced_rows"),
        F.coalesce(F.sum(F.when(F.col("unit_usd").isNull(), F.col("quantity"))), F.lit(0)).cast("long").alias("unpriced_quantity"),
    )


def daily_rates(quotes: DataFrame, days: int = 10) -> DataFrame:
    """(day, rate): the latest quote of at most ``days`` days before, for every day that has one.

    Each quote is spread over the days it may serve and the latest wins a day, so the as-of join becomes a join on day.
    ``quotes`` is (quoted_on date, rate).
    """
    spread = quotes.select("quoted_on", "rate", F.explode(F.sequence(F.col("quoted_on"), F.date_add("quoted_on", days))).alias("day"))
    return spread.groupBy("day").agg(F.max_by("rate", F.col("quoted_on")).alias("rate"))


def at_rate(rows: DataFrame, day: str, quotes: DataFrame, days: int = 10, fallback: float = FALLBACK_RATE) -> DataFrame:
    """Rows with the rate of their day, or the fallback."""
    rates = daily_rates(quotes, days).withColumnRenamed("day", day)
    return rows.join(rates, day, "left").withColumn("rate", F.coalesce("rate", F.lit(fallback)))
