"""op13's disk: what a round of training leaves, rows without label before the join, means of the words that shards met."""

from __future__ import annotations

import os
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from test_toxicity import made

from tallyforge.llm import toxicity


def _files(spark):
    """Bytes by file of shuffles, broadcasts and the driver's own copies of broadcasts."""
    tops = [*spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString(), spark.sparkContext._temp_dir]
    out = {}
    for top in tops:
        for folder, _, names in os.walk(top):
            for name in names:
                path = f"{folder}/{name}"
                if os.path.exists(path):
                    out[path] = os.path.getsize(path)
    return out


def test_learning_leaves_no_files(spark, monkeypatch):
    """Shuffles and copies of the networks stayed until the driver collected its garbage, eight rounds of them."""
    for name, value in (("SHARD_DOCS", 60), ("EVERY_ROUND", 300), ("LEAST_DOCS", 3)):
        monkeypatch.setattr(toxicity, name, value)
    rows, labels = made(600)
    docs, told = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").cache(), spark.createDataFrame(labels, "doc_id long, toxic int").cache()
    docs.count(), told.count()
    before = _files(spark)
    model = toxicity.learn(docs, told)
    for _ in range(20):  # removal need not be done at once
        left = sum(n for path, n in _files(spark).items() if path not in before)
        if left < 20_000:
            break
        time.sleep(0.2)
    assert "nets" in model and left < 20_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")


def test_rows_without_label_are_left_before_the_join(spark):
    told = spark.range(0, 3000, 3).select(F.col("id").alias("doc_id"))
    marks = toxicity.marked_rows(told, 1000)
    ids = spark.range(3000).select(F.col("id").alias("doc_id")).select("doc_id", toxicity._bit(8 * len(marks)).alias("bit")).toPandas()
    there = marks[ids.bit.to_numpy() >> 3] >> (ids.bit.to_numpy() & 7) & 1
    assert there[ids.doc_id % 3 == 0].all() and there[ids.doc_id % 3 != 0].mean() < 0.1
    assert len(toxicity.marked_rows(told.where("false"), 0)) == toxicity.BLOCK_BITS // 8


def test_means_of_words_met():
    """Each word by how often a shard met it; what no shard met is as before, and what none ever met is left out."""
    dim, rng = toxicity.DIM, np.random.default_rng(3)
    rows = [(-1, [1, 2, 7], None), (0, [2, 5], [3, 1]), (2, [5, 9], [4, 2])]
    value, past = ([rng.random((len(at), dim)).astype(np.float32) for _, at, _ in rows] for _ in range(2))
    packed = lambda x, kind: np.asarray(x, kind).tobytes()
    table = [
        {"net": 1, "slice": 0, "shard": shard, "at": packed(at, np.int32), "met": packed(met or [], np.int64), "value": v.tobytes(), "past": p.tobytes(), "part": 4}
        for (shard, at, met), v, p in zip(rows, value, past, strict=True)
    ]
    (batch,) = toxicity._averaged(iter([pa.RecordBatch.from_pylist(table[::-1], toxicity._SLICES)]))
    (at,), (got,), (sums,) = (toxicity._unpacked(batch, c) for c in ("at", "value", "past"))
    assert at.tolist() == [1, 2, 5, 7, 9] and batch.column("shard").to_pylist() == [-1]
    for x, out in ((value, got), (past, sums)):
        want = [x[0][0], x[1][0], (x[1][1] + 4 * x[2][0]) / 5, x[0][2], x[2][1]]
        np.testing.assert_allclose(out.reshape(-1, dim), want, rtol=1e-6)
    assert not list(toxicity._averaged(iter([pa.RecordBatch.from_pylist([], toxicity._SLICES)])))
