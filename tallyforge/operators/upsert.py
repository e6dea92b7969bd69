"""Refreshing tables of files: upsert, back-fill, target selection and freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key; the rest of the old rows stay."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def inserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows stay; new rows join them only under keys of their own."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def backfilled(df: DataFrame, source: DataFrame, keys: list[str], column: str) -> DataFrame:
    """A column's nulls from a second source."""
    filled = source.select(*keys, F.col(column).alias("__fill"))
    return df.join(filled, keys, "left").withColumn(column, F.coalesce(column, "__fill")).drop("__fill")


def fresh(df: DataFrame, fetched_at: str, now: Column, seconds: float, keys: list[str]) -> DataFrame:
    """The latest row of each key that is not older than ``seconds`` and holds an answer (status 200 or 404)."""
    rows = df.where((now - F.col(fetched_at) < seconds) & F.col("status").isin(200, 404))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), F.col(fetched_at)).alias("row")).select(*keys, "row.*")


def replaced_partition(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrites only the partitions that ``df`` has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
