"""Thresholds, accuracy, medians and outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sweep(df: DataFrame, score: str, good: Column, cuts: list[float]) -> DataFrame:
    """For each cut, the share of rows kept and how many of those are good, in one pass over the rows."""
    keep = [F.col(score) >= c for c in cuts]
    parts = [F.struct(F.lit(c).alias("cut"), F.count_if(k).alias("kept"), F.count_if(k & good).alias("right"), F.count(F.lit(1)).alias("n")) for c, k in zip(cuts, keep, strict=True)]
    rows = df.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    return rows.select("cut", F.round(F.col("kept") / F.col("n"), 6).alias("kept_share"), F.round(F.col("right") / F.col("kept"), 6).alias("precision"))


def long_spans(df: DataFrame, group: list[str], span: str, least: float = 16.0, factor: float = 1.8) -> DataFrame:
    """Rows whose span is an outlier: at least ``least`` and ``factor`` times the group's median."""
    m = df.groupBy(*group).agg(F.median(span).alias("median"))
    return df.join(m, group).where(F.col(span) >= F.greatest(F.lit(least), factor * F.col("median")))


def rolling_median(df: DataFrame, group: list[str], order: list[Column], value: str, rows: int = 15, name: str = "rolling") -> DataFrame:
    """Median of the ``rows`` rows before each row (Spark's own median takes no frame)."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(-rows, -1)
    held = F.sort_array(F.collect_list(value).over(w))
    n = F.size(held)
    middle = (F.get(held, F.floor((n - 1) / 2).cast("int")) + F.get(held, F.floor(n / 2).cast("int"))) / 2
    return df.withColumn(name, F.when(n > 0, middle))


def order_statistic(df: DataFrame, group: list[str], value: str, share: float, name: str, bins: int = 1024) -> DataFrame:
    """The value at index floor(share * n) of the sorted values (no interpolation); null values do not count.

    Values are counted in ``bins`` equal ranges of their group, the bin that holds the index is found by running counts,
    and only that bin's different values are put in order.
    """
    rows = df.where(F.col(value).isNotNull()).select(*group, F.col(value).alias("__v"))
    ends = rows.groupBy(*group).agg(F.min("__v").alias("__low"), F.max("__v").alias("__high"), F.count(F.lit(1)).alias("__n"))
    at = F.least(F.floor(F.lit(share) * F.col("__n")), F.col("__n") - 1)
    width = F.col("__high").cast("double") - F.col("__low").cast("double")
    bin_ = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("__v") - F.col("__low")) / width * bins))).otherwise(F.lit(0)).cast("int")
    counts = rows.join(ends, group).withColumn("__at", at).groupBy(*group, "__at", bin_.alias("__bin"), "__v").agg(F.count(F.lit(1)).alias("__c"))
    sums = counts.groupBy(*group, "__at", "__bin").agg(F.sum("__c").alias("__c"))
    up = lambda *keys: Window.partitionBy(*group, *keys[:-1]).orderBy(keys[-1])
    found = sums.withColumn("__end", F.sum("__c").over(up("__bin"))).withColumn("__from", F.col("__end") - F.col("__c")).where("__from <= __at and __at < __end")
    values = counts.drop("__at").join(found.select(*group, "__bin", "__at", "__from"), [*group, "__bin"])
    values = values.withColumn("__end", F.col("__from") + F.sum("__c").over(up("__bin", "__v"))).where("__at < __end")
    return values.groupBy(*group).agg(F.min("__v").alias(name))
