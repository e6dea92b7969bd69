"""Statistics queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import circular_mean
from ..functions.text import condition_grade, grid_label
from ..operators.statistics import long_spans, rolling_median, sweep
from .registry import Tables, query


@query("""
SELECT user_id, round(((degrees(atan2(sum(value * sin(radians(event_id % 180) * 2)), sum(value * cos(radians(event_id % 180) * 2)))) / 2) % 180 + 180) % 180, 4) AS angle FROM events GROUP BY 1
""")
def circular_mean_angle(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.round(circular_mean((F.col("event_id") % 180).cast("double"), F.col("value")), 4).alias("angle"))


@query("""
WITH m AS (SELECT event_type, median(value) AS m FROM events GROUP BY 1)
SELECT event_type, count(*) AS n, round(max(value), 2) AS largest FROM events JOIN m USING (event_type) WHERE value >= greatest(16, 1.8 * m) GROUP BY 1
""")
def median_outliers(t: Tables) -> DataFrame:
    return long_spans(t.events, ["event_type"], "value").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("value"), 2).alias("largest"))


@query("""
SELECT user_id, event_id, round(median(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING), 4) AS rolling FROM events
""")
def rolling_medians(t: Tables) -> DataFrame:
    return rolling_median(t.events, ["user_id"], [F.col("ts"), F.col("event_id")], "value").select("user_id", "event_id", F.round("rolling", 4).alias("rolling"))


@query("""
WITH r AS (SELECT n_chars / 4000.0 AS score, quality = 1 AS good FROM documents JOIN labels USING (doc_id)), c AS (SELECT unnest([0.1, 0.25, 0.5, 1.0]) AS cut)
SELECT CAST(cut AS DOUBLE) AS cut, round(avg(CASE WHEN score >= cut THEN 1.0 ELSE 0.0 END), 6) AS kept_share, round(avg(CASE WHEN good THEN 1.0 ELSE 0.0 END) FILTER (WHERE score >= cut), 6) AS precision FROM r, c GROUP BY cut
""")
def threshold_sweep(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id").select((F.col("n_chars") / 4000.0).alias("score"), (F.col("quality") == 1).alias("good"))
    return sweep(rows, "score", F.col("good"), [0.1, 0.25, 0.5, 1.0])


@query("""
SELECT lang, count(*) AS detected, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
  round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END) FILTER (WHERE n_chars > 1000), 6) AS confident_accuracy FROM documents JOIN labels USING (doc_id) GROUP BY 1
""")
def accuracy_report(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id")
    right = F.when(F.col("quality") == 1, 1.0).otherwise(0.0)
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("detected"), F.round(F.avg(right), 6).alias("accuracy"), F.round(F.avg(F.when(F.col("n_chars") > 1000, right)), 6).alias("confident_accuracy"))


@query("""
SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE value > 50) AS high,
  count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view FROM events GROUP BY 1
""")
def stats_conditional(t: Tables) -> DataFrame:
    """Conditional counts, and counts by kind through a map."""
    per = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("value") > 50).alias("high"))
    maps = per.groupBy("user_id").agg(F.sum("k").alias("n"), F.sum("high").alias("high"), F.map_from_entries(F.collect_list(F.struct("event_type", "k"))).alias("by"))
    kind = lambda k: F.coalesce(F.col("by")[k], F.lit(0).cast("long")).alias(k)
    return maps.select("user_id", "n", F.coalesce(F.col("by")["error"], F.lit(0).cast("long")).alias("errors"), "high", kind("click"), kind("view"))


@query("""
SELECT event_id FROM events WHERE value / 100 < 0.05 OR event_id % 97 = 0
""")
def review_filter(t: Tables) -> DataFrame:
    """Rows of low confidence or with warnings."""
    warnings = F.filter(F.array(F.when(F.col("event_id") % 97 == 0, "odd")), lambda x: x.isNotNull())
    return t.events.where((F.col("value") / 100 < 0.05) | (F.size(warnings) > 0)).select("event_id")


@query("""
SELECT CASE WHEN p_type IN ('PROMO', 'LARGE') THEN 'first' WHEN p_size > 25 THEN 'second' ELSE 'rest' END AS section, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS total,
  array_to_string(list_sort(list(DISTINCT p_type)), ',') AS types FROM part GROUP BY 1
""")
def section_groups(t: Tables) -> DataFrame:
    section = F.when(F.col("p_type").isin("PROMO", "LARGE"), "first").when(F.col("p_size") > 25, "second").otherwise("rest")
    return t.part.groupBy(section.alias("section")).agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("total"), F.array_join(F.sort_array(F.collect_set("p_type")), ",").alias("types"))


@query("""
SELECT o_orderpriority AS list, min(o_totalprice / 1000) AS confidence FROM orders GROUP BY 1
""")
def list_confidence(t: Tables) -> DataFrame:
    """A line is as sure as its least sure row."""
    return t.orders.groupBy(F.col("o_orderpriority").alias("list")).agg(F.min(F.col("o_totalprice") / 1000).alias("confidence"))


@query("""
SELECT count(*) FILTER (WHERE e.user_id IS NOT NULL AND kind <> 'error') AS sent, count(*) FILTER (WHERE kind = 'error') AS failed, count(*) FILTER (WHERE e.user_id IS NULL) AS no_account
FROM customer LEFT JOIN (SELECT user_id, min(event_type) AS kind FROM events WHERE event_id % 3 = 0 GROUP BY 1) e ON c_custkey = user_id
""")
def delivery_counts(t: Tables) -> DataFrame:
    linked = t.events.where("event_id % 3 = 0").groupBy(F.col("user_id").alias("c_custkey")).agg(F.min("event_type").alias("kind"))
    rows = t.customer.join(linked, "c_custkey", "left")
    kind = F.col("kind")
    return rows.agg(F.count_if(kind.isNotNull() & (kind != "error")).alias("sent"), F.count_if(F.coalesce(kind == "error", F.lit(False))).alias("failed"), F.count_if(kind.isNull()).alias("no_account"))


@query("""
SELECT CASE WHEN vec_id % 100 / 100.0 < 0.02 THEN 'NM' WHEN vec_id % 100 / 100.0 < 0.06 THEN 'LP' WHEN vec_id % 100 / 100.0 < 0.14 THEN 'MP' WHEN vec_id % 100 / 100.0 < 0.3 THEN 'HP' ELSE 'DMG' END AS grade,
  CASE WHEN embedding[2] < 1 / 3 THEN 'top' WHEN embedding[2] < 2 / 3 THEN 'center' ELSE 'bottom' END || ' ' || CASE WHEN embedding[1] < 1 / 3 THEN 'left' WHEN embedding[1] < 2 / 3 THEN 'middle' ELSE 'right' END AS place, count(*) AS n
FROM embeddings GROUP BY 1, 2
""")
def grades_and_places(t: Tables) -> DataFrame:
    e = F.col("embedding")
    return t.embeddings.groupBy(condition_grade(F.col("vec_id") % 100 / 100).alias("grade"), grid_label(e[0], e[1]).alias("place")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT d.user_id, d.event_id, max(e.event_id) AS previous FROM events d LEFT JOIN events e ON d.user_id = e.user_id AND d.event_type = e.event_type AND e.event_id < d.event_id GROUP BY 1, 2
""")
def previous_same(t: Tables) -> DataFrame:
    """The latest earlier row of the same session and kind."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    return t.events.select("user_id", "event_id", F.lag("event_id").over(w).alias("previous"))
