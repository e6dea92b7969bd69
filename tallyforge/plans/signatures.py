"""Signature queries: the signs and steps of an embedding's components are its signatures, labels are items."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hamming import confidence, sign_bits, similarity
from ..operators.disk_index import DiskIndex
from ..operators.nearest import nearest, nearest_in_two_stages, neighbours
from ..operators.rank import other_key_best
from ..operators.tables import shared_folder
from .registry import Tables, query

SIGNED = """
WITH s AS (
  SELECT vec_id AS id, label AS item,
    list_sum([CASE WHEN embedding[i + 1] > 0 THEN 1::HUGEINT << i ELSE 0 END for i in range(0, 64)])::HUGEINT AS art,
    list_sum([CASE WHEN embedding[i + 1] > embedding[(i + 1) % 64 + 1] THEN 1::HUGEINT << i ELSE 0 END for i in range(0, 64)])::HUGEINT AS full_,
    CASE WHEN vec_id % 5 = 0 THEN 2.0 ELSE 0.0 END::DOUBLE AS bonus
  FROM embeddings
), d AS (
  SELECT q.id AS query_id, r.id, r.item, bit_count(xor(q.art, r.art)) + 0.5::DOUBLE * bit_count(xor(q.full_, r.full_)) - r.bonus::DOUBLE AS score
  FROM s q JOIN s r ON q.id % 20 = 0 AND r.id <> q.id
)
"""


def signed(t: Tables) -> tuple[DataFrame, DataFrame]:
    e = F.col("embedding")
    rows = t.embeddings.select(
        F.col("vec_id").alias("id"), F.col("label").alias("item"), F.array(sign_bits(e, 0, 64)).alias("art"), F.array(sign_bits(e, 0, 64, 1)).alias("full"),
        F.when(F.col("vec_id") % 5 == 0, 2.0).otherwise(0.0).alias("bonus"),
    )
    return rows, rows.where("id % 20 = 0")


@query(SIGNED + """
SELECT query_id, id, score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS r FROM d) WHERE r <= 5
""")
def knn_hamming(t: Tables) -> DataFrame:
    return nearest(*signed(t), 5).select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


@query(SIGNED + """
, a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS r FROM d),
b AS (SELECT *, score + 0.1::DOUBLE * ((id * 7) % 11) AS final FROM a WHERE r <= 12), c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final, id) AS k FROM b)
SELECT query_id, id, round(final, 6) AS final, k AS rank FROM c WHERE k <= 4
""")
def knn_two_stage(t: Tables) -> DataFrame:
    """A coarse ranking of three times as many, then a second score; the answer may differ from one stage."""
    out = nearest_in_two_stages(*signed(t), 4, 0.1 * ((F.col("id") * 7) % 11))
    return out.select("query_id", "id", F.round("final", 6).alias("final"), F.col("rank").cast("long").alias("rank"))


@query(SIGNED + """
, k AS (SELECT query_id, item, min(score) AS score FROM d GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, item) AS r FROM k),
b AS (SELECT query_id, max(item) FILTER (WHERE r = 1) AS item, max(score) FILTER (WHERE r = 1) AS best, max(score) FILTER (WHERE r = 2) AS rival FROM o WHERE r <= 2 GROUP BY 1)
SELECT query_id, item, best, rival, round(least(0.995, 1 / (1 + exp(-(coalesce(rival - best, 60) - 12) / 8))), 6) AS confidence FROM b
""")
def knn_confidence(t: Tables) -> DataFrame:
    """The best item of each query, the best rival of another item, and the confidence of the margin."""
    best = other_key_best(nearest(*signed(t), 2, "item", ties="item"), ["query_id"], "item", "score")
    return best.withColumn("confidence", F.round(confidence(F.col("best"), F.col("rival")), 6))


@query(SIGNED + """
, k AS (SELECT *, row_number() OVER (PARTITION BY query_id, item ORDER BY score, id) AS r FROM d), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS n FROM k WHERE r = 1)
SELECT query_id, item, id, n, round(least(1, greatest(0, 1 - score / 110)), 6) AS similarity FROM o WHERE n <= 3
""")
def distinct_topn(t: Tables) -> DataFrame:
    """The three best rows of different items."""
    best = nearest(*signed(t), 3, "item")
    return best.select("query_id", "item", "id", F.col("rank").cast("long").alias("n"), F.round(similarity(F.col("score")), 6).alias("similarity"))


@query("""
WITH p AS (SELECT label AS g, vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
d AS (SELECT a.g, a.id, b.id AS other, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS distance FROM p a JOIN p b ON a.g = b.g AND a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY g, id ORDER BY distance, other) AS k FROM d WHERE distance <= 0.05)
SELECT g AS label, id, other, round(distance, 6) AS distance FROM r WHERE k <= 4
""")
def neighbors_topk(t: Tables) -> DataFrame:
    points = t.embeddings.select("label", F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return neighbours(points, "label", 0.05, 4).select("label", "id", "other", F.round("distance", 6).alias("distance"))


@query("""
WITH p AS (SELECT label, unnest([embedding[1], embedding[2], NULL, embedding[4]]) AS v, unnest([3.0, 2.0, 5.0, 1.0]) AS w FROM embeddings)
SELECT label, round(sum(w * v) / sum(CASE WHEN v IS NOT NULL THEN w END), 6) AS combined FROM p GROUP BY 1
""")
def weighted_combination(t: Tables) -> DataFrame:
    """Weighted mean that leaves missing parts out of both sums."""
    e = F.col("embedding")
    parts = F.array(*[F.struct(v.cast("double").alias("v"), F.lit(w).alias("w")) for v, w in ((e[0], 3.0), (e[1], 2.0), (F.lit(None), 5.0), (e[3], 1.0))])
    rows = t.embeddings.select("label", F.explode(parts).alias("p"))
    return rows.groupBy("label").agg(F.round(F.sum(F.col("p.w") * F.col("p.v")) / F.sum(F.when(F.col("p.v").isNotNull(), F.col("p.w"))), 6).alias("combined"))


@query("""
SELECT label, count(*) FILTER (WHERE embedding[1] - embedding[2] >= 0.03) AS first, count(*) FILTER (WHERE embedding[2] - embedding[1] >= 0.03) AS second, count(*) AS n FROM embeddings GROUP BY 1
""")
def region_votes(t: Tables) -> DataFrame:
    """Votes of two scores with a dead band."""
    gap = F.col("embedding")[0] - F.col("embedding")[1]
    band = F.lit(0.03).cast("float")
    return t.embeddings.groupBy("label").agg(F.count_if(gap.cast("float") >= band).alias("first"), F.count_if(-gap.cast("float") >= band).alias("second"), F.count(F.lit(1)).alias("n"))


@query("""
WITH s AS (SELECT vec_id AS id, CASE WHEN vec_id % 9 = 0 THEN label + 1000 ELSE label END AS item, list_sum([CASE WHEN embedding[i + 1] > 0 THEN 1::HUGEINT << i ELSE 0 END for i in range(0, 64)])::HUGEINT AS bits FROM embeddings)
SELECT id, item, CAST(CASE WHEN bits >= 9223372036854775808 THEN bits - 18446744073709551616 ELSE bits END AS BIGINT) AS art, n FROM s JOIN (SELECT user_id AS id, count(*) AS n FROM events GROUP BY 1) USING (id)
""")
def signature_index(t: Tables) -> DataFrame:
    """Signatures put on disk, corrected by a second build, and probed with the users of all events."""
    rows = signed(t)[0].select(F.col("id").cast("long").alias("id"), F.col("item").cast("long").alias("item"), F.col("art")[0].alias("art"))
    index = DiskIndex(t.spark, f"{shared_folder(t.spark)}/signatures-{uuid.uuid4().hex}", rows.schema, "id")
    index.build(rows)
    index.build(index.load()[0].withColumn("item", F.when(F.col("id") % 9 == 0, F.col("item") + 1000).otherwise(F.col("item"))))
    return index.probe(t.events.groupBy(F.col("user_id").cast("long").alias("id")).agg(F.count(F.lit(1)).alias("n"))).select("id", "item", "art", "n")
