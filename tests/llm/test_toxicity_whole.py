"""every labelled document teaches, in shards that are averaged."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from test_toxicity import made

from tallyforge.llm import toxicity
from tallyforge.llm.toxicity import held_out


def test_f14_documents_beyond_a_sample_teach(spark):
    """A word that stands only in documents which a sample of 3,000 a label left out is learned too."""
    ids = spark.range(4600).select(F.col("id").alias("doc_id")).where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64(F.lit("learn"), "doc_id"))
    ids = [r.doc_id for r in ids.collect()]
    assert len(ids) > 3100
    late = set(ids[-40:])
    rows = [(i, "plain words here" + (" seldom" if i in late else ""), "en") for i in ids] + [(10_000 + k, "vile words here", "en") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") >= 10_000).cast("int").alias("toxic"))
    learned, counts = toxicity.learning_rows(docs, labels)
    assert learned.count() == counts.sum() == docs.where(~held_out(F.col("doc_id"))).count()
    number, names, _ = toxicity.vocabulary(learned)
    assert names == ["en"] and number[toxicity.listed_words(pa.array(["seldom"]))[0][0]] > 0


def test_f14_long_documents_teach(spark):
    """A document above 1 MiB was left out of learning."""
    docs = spark.createDataFrame([(2, "long " * 300_000, "en"), (3, "", "en"), (4, None, "en")], "doc_id long, text string, lang string")
    labels = docs.select(F.col("doc_id"), F.lit(1).alias("toxic"))
    rows, _ = toxicity.learning_rows(docs, labels)
    sizes = sorted(len(r.words) // 4 for r in rows.collect())
    assert sizes == sorted(n for i, n in ((2, 300_000), (3, 0)) if not _held(spark, i))


def _held(spark, doc_id):
    return spark.range(1).select(held_out(F.lit(doc_id))).first()[0]


def test_f14_shards_are_averaged(spark, monkeypatch):
    """Several shards and fewer passes still tell toxic documents, the same way each time."""
    for name, value in (("SHARD_DOCS", 60), ("EVERY_ROUND", 300), ("WALK", 64)):
        monkeypatch.setattr(toxicity, name, value)
    rows, labels = made(1500)
    docs, told = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    a, b = toxicity.learn(docs, told), toxicity.learn(docs.repartition(7), told)
    assert all((x == y).all() for n, m in zip(a["nets"], b["nets"], strict=True) for x, y in zip(n.parameters(), m.parameters(), strict=True))
    held = [r for r in toxicity.toxicity(docs, a).collect() if r.held_out]
    assert np.mean([r.predicted == dict(labels)[r.doc_id] for r in held]) > 0.9


def test_f14_windows_of_long_rows_in_parts(monkeypatch):
    rng = np.random.default_rng(1)
    net = toxicity.Network(50)
    ids, rows = toxicity.padded(rng.integers(0, 50, 900).astype(np.int32), np.array([0, 0, 5, 600, 900]))
    whole = [net.strongest(ids, rows, w, t) for w, t in zip(toxicity.WIDTHS, net.taps, strict=True)]
    monkeypatch.setattr(toxicity, "WALK", 37)
    for (at, best), w, t in zip(whole, toxicity.WIDTHS, net.taps, strict=True):
        again = net.strongest(ids, rows, w, t)
        np.testing.assert_allclose(again[1], best, atol=1e-6)
        assert (again[0] == at).mean() > 0.95
