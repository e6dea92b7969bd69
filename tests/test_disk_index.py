from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tallyforge.operators.disk_index import DiskIndex


def test_builds_swap_whole(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(500)] + [(None, "none")], "id long, v string")
    index = DiskIndex(spark, f"file://{tmp_path}", rows.schema, "id")
    assert index.load()[0].count() == 0 and index.some([1]).count() == 0 and index.versions() == []
    assert index.build(rows, 8) == 1
    assert index.load()[0].count() == 500 and [r.v for r in index.some([7, 7, 900]).collect()] == ["v7"]
    first = index.load()[0]
    assert index.build(rows.where("id < 10"), 4) == 2
    assert first.count() == 500 and index.load()[0].count() == 10  # who reads the old build still can
    assert sorted((r.id, r.v) for r in index.probe(spark.createDataFrame([(3,), (12,), (None,)], "id long")).collect()) == [(3, "v3")]
    assert index.build(index.load()[0]) == 3 and index.versions() == [2, 3]
    assert len([f for f in os.listdir(tmp_path) if f.startswith("build-")]) == 2


def test_few_keys_open_few_buckets(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id", "id * 2 as v")
    index = DiskIndex(spark, f"file://{tmp_path}", rows.schema, "id")
    index.build(rows, 8)
    found = index.some([5])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,5)" in plan and "PartitionFilters" in plan
    opened = {f.split("bucket=")[1].split("/")[0] for f in found.select("v", F.input_file_name().alias("f")).toPandas().f}
    assert len(opened) == 1 and [r.v for r in found.collect()] == [10]


def test_a_number_is_taken_once(spark, tmp_path, monkeypatch):
    rows = spark.range(10)
    index = DiskIndex(spark, f"file://{tmp_path}", rows.schema, "id")
    index.build(rows)
    monkeypatch.setattr(index, "versions", lambda: [])  # a builder that did not see the other's manifest
    with pytest.raises(RuntimeError, match="number 1"):
        index.build(rows)
