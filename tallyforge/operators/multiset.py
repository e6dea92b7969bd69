"""Multisets as (key, quantity) tables: compare, subtract, allocate and match by rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank import numbered


def counted(df: DataFrame, keys: list[str], quantity: Column | None = None) -> DataFrame:
    return df.groupBy(*keys).agg((F.sum(quantity) if quantity is not None else F.count(F.lit(1))).cast("long").alias("quantity"))


def compared(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Both quantities of each key, and how many agree, are missing and are extra."""
    both = expected.withColumnRenamed("quantity", "expected").join(found.withColumnRenamed("quantity", "found"), keys, "full_outer")
    e, f = F.coalesce("expected", F.lit(0)), F.coalesce("found", F.lit(0))
    return both.select(*keys, e.alias("expected"), f.alias("found"), F.least(e, f).alias("ok"), F.greatest(e - f, F.lit(0)).alias("missing"), F.greatest(f - e, F.lit(0)).alias("extra"))


def change_kind(before: Column, after: Column) -> Column:
    return F.when(before == 0, "added").when(after == 0, "removed").when(before != after, "changed").otherwise("same")


def rank_matched(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[Column], right_order: list[Column], how: str = "full_outer") -> DataFrame:
    """Joins the k-th row of a key on the left with its k-th row on the right (column k)."""
    return numbered(left, keys, left_order, "k").join(numbered(right, keys, right_order, "k"), [*keys, "k"], how)


def waterfall(demand: DataFrame, supply: DataFrame, keys: list[str]) -> DataFrame:
    """How each demand is met: here, move from free stock, conflict with other owners' stock, buy.

    ``demand`` has keys and needed; ``supply`` has keys, here, free and elsewhere.
    """
    s = demand.join(supply, keys, "left").fillna(0, ["here", "free", "elsewhere"])
    here = F.least("needed", "here")
    missing = F.col("needed") - here
    move = F.least(missing, F.col("free"))
    conflict = F.least(missing - move, F.col("elsewhere"))
    out = s.select(*keys, "needed", here.alias("here"), missing.alias("missing"), move.alias("move"), conflict.alias("conflict"), (missing - move - conflict).alias("buy"))
    status = F.when(F.col("conflict") > 0, "conflict").when(F.col("buy") > 0, "buy").when(F.col("move") > 0, "move").otherwise("ok")
    return out.withColumn("status", status)


STATUS_ORDER = ["conflict", "buy", "move", "ok"]


def status_rank(status: Column) -> Column:
    out = F.lit(len(STATUS_ORDER))
    for i, s in enumerate(STATUS_ORDER):
        out = F.when(status == s, i).otherwise(out)
    return out
