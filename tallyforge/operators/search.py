"""Search: prefix and substring tokens, trigram similarity, BM25 over an inverted index, and lookups in stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import all_words_match, grams, name_norm, tokens
from .tables import written


def token_matches(df: DataFrame, text: str, query: str, prefix: bool = True) -> DataFrame:
    """Rows in which every word of the query opens (or is within) some word."""
    wanted = [w for w in query.lower().split() if w]
    return df.withColumn("__words", tokens(F.col(text))).where(all_words_match(F.col("__words"), wanted, prefix)).drop("__words")


def match_class(norm: Column, query: str) -> Column:
    """0 for the whole name, 1 for its opening, 2 for anything else."""
    return F.when(norm == query, 0).when(norm.startswith(query), 1).otherwise(2)


def trigram_similarity(df: DataFrame, text: str, query: str, name: str = "similarity") -> DataFrame:
    """Shared trigrams over all trigrams of both texts."""
    mine, wanted = grams(name_norm(F.col(text))), grams(F.lit(query.lower()))
    both = F.size(F.array_intersect(mine, wanted))
    return df.withColumn(name, both / (F.size(mine) + F.size(wanted) - both))


def inverted_index(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(token, id, tf, length): one row for each distinct token of a document."""
    words = docs.select(F.col(id_col).alias("id"), tokens(F.col(text)).alias("words")).where(F.size("words") > 0)
    return words.select("id", F.size("words").alias("length"), F.explode("words").alias("token")).groupBy("token", "id", "length").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, id_col: str, text: str, query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, rank): smaller is better, as in full-text engines that rank by negated BM25.

    Texts are read and tokenised once: a written row a document holds its length and how often it has each query token.
    Corpus counts are one row over that table, and a document's rank needs nothing but its own row. Documents without a
    token do not count; tokens asked for twice count once.
    """
    query = list(dict.fromkeys(query))
    words = docs.select(F.col(id_col).alias("id"), tokens(F.col(text)).alias("words")).where(F.size("words") > 0)
    hits = written(words.select("id", F.size("words").alias("length"), *[F.size(F.filter("words", _equals(w))).alias(f"tf{i}") for i, w in enumerate(query)]))
    corpus = hits.agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(query))])
    rank = F.lit(0.0)
    for i in range(len(query)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        rank = rank - F.log(1 + (F.col("docs") - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    found = hits.where(F.greatest(F.lit(0), *[F.col(f"tf{i}") for i in range(len(query))]) > 0)
    return found.join(F.broadcast(corpus)).select("id", rank.alias("rank"))  # one row


def _equals(word: str):
    return lambda x: x == word


def resolve_in_stages(asked: DataFrame, key: str, stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """Adds id and method: the first stage (name, table of key and id) that knows a row's key.

    Each stage is a left join on a column of the stage's own name in ``asked``.
    """
    out = asked
    for name, table in stages:
        out = out.join(table.select(F.col("key").alias(name), F.col("id").alias(f"__{name}")), name, "left")
    found = F.coalesce(*[F.when(F.col(f"__{n}").isNotNull(), F.struct(F.col(f"__{n}").alias("id"), F.lit(n).alias("method"))) for n, _ in stages])
    return out.withColumn("__found", found).select(key, F.col("__found.id").alias("id"), F.coalesce("__found.method", F.lit("unresolved")).alias("method"))
