"""Holdings grouped by item, and where they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grouped(copies: DataFrame, item: str, variant: str, place: str, at: str) -> DataFrame:
    """Per item: copies, variants and places with counts (largest first), the commonest variant and the latest time."""
    per_variant = copies.groupBy(item, variant).agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("at"))
    per_place = copies.groupBy(item, place).agg(F.count(F.lit(1)).alias("n"))
    listed = lambda c: F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col(c).alias("key")))), lambda x: F.struct(x["key"].alias("key"), (-x["o"]).alias("n")))
    by_variant = per_variant.groupBy(item).agg(F.sum("n").alias("copies"), F.max("at").alias("latest"), listed(variant).alias("variants"))
    by_place = per_place.groupBy(item).agg(listed(place).alias("places"))
    return by_variant.join(by_place, item).withColumn("representative", F.col("variants")[0]["key"])


def located(copies: DataFrame, places: DataFrame, lists: DataFrame, place: str, owner: str) -> DataFrame:
    """Copies with the place's name; a place that belongs to a list takes the list's name."""
    out = copies.join(places, place, "left").join(lists, owner, "left")
    return out.withColumn("where", F.when(F.col("place_type") == "deck", F.coalesce("list_name", "place_name")).otherwise(F.col("place_name")))
