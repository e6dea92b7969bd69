"""Best rows and running allowances; every order ends in a unique key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. ``order`` columns sort ascending; it combines on the map side, unlike a window."""
    rows = df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("best"))
    return rows.select("best.*")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "n") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def running_allowance(df: DataFrame, keys: list[str], order: list[Column], quantity: str, limit: Column, name: str = "allowed") -> DataFrame:
    """How much of each row fits a key's limit if rows are served in order; a null limit allows all."""
    before = F.sum(quantity).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    left = F.greatest(limit - F.coalesce(before, F.lit(0)), F.lit(0))
    return df.withColumn(name, F.when(limit.isNull(), F.col(quantity)).otherwise(F.least(F.col(quantity), left)))


def other_key_best(df: DataFrame, group: list[str], key: str, score: str) -> DataFrame:
    """Each group's best key and score, and the best score of any other key. Ties go to the smaller key."""
    per_key = df.groupBy(*group, key).agg(F.min(score).alias(score))
    two = top_per_key(per_key, group, [F.col(score), F.col(key)], 2, "__n")
    return two.groupBy(*group).agg(F.min_by(key, "__n").alias(key), F.min(F.when(F.col("__n") == 1, F.col(score))).alias("best"), F.min(F.when(F.col("__n") == 2, F.col(score))).alias("rival"))


def apportion(df: DataFrame, keys: list[str], weight: str, total: Column, order: Column, name: str = "share") -> DataFrame:
    """Largest-remainder shares of ``total`` in each group; ties keep ``order``, zero weights share equally."""
    group = Window.partitionBy(*keys)
    sum_, n = F.sum(weight).over(group), F.count(F.lit(1)).over(group)
    exact = F.when(sum_ > 0, F.col(weight) * total / sum_).otherwise(total / n)
    out = df.withColumn("__exact", exact).withColumn("__floor", F.floor("__exact"))
    rest = total - F.sum("__floor").over(group)
    nth = F.row_number().over(group.orderBy(F.desc(F.round(F.col("__exact") - F.col("__floor"), 9)), order))
    out = out.withColumn("__rest", rest).withColumn("__nth", nth)
    return out.withColumn(name, (F.col("__floor") + (F.col("__nth") <= F.col("__rest")).cast("int")).cast("long")).drop("__exact", "__floor", "__rest", "__nth")


def seeded_sample(df: DataFrame, keys: list[str], id_col: str, n: int, seed: int) -> DataFrame:
    """n rows, one for each key, in the order of the MD5 of ``seed/id``."""
    one = best_per_key(df.withColumn("__h", F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary"))), keys, [F.col("__h"), F.col(id_col)])
    return one.orderBy("__h", id_col).limit(n).drop("__h")
