from __future__ import annotations

import datetime as dt
import json

from tallyforge.streaming import flows

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "k string, at timestamp, id long"


def rows(*items):
    return [(k, T0 + dt.timedelta(seconds=s), i) for k, s, i in items]


def feed(spark, tmp_path, batches, name="in"):
    for i, b in enumerate(batches):
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    return flows.read_events(spark, str(tmp_path / name), SCHEMA)


def drained(df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def test_ingest_once(spark, tmp_path):
    stream = feed(spark, tmp_path, [rows(("a", 0, 1), ("b", 1, 2)), rows(("a", 2, 3), ("c", 3, 4))])
    assert sorted(r.k for r in drained(flows.ingested_once(stream, ["k"], "at", "1 hour"), tmp_path, "once")) == ["a", "b", "c"]


def test_json_lines(spark, tmp_path):
    stream = feed(spark, tmp_path, [rows(("a", 0, 1)), rows(("b", 1, 2))])
    flows.write_json_lines(stream.select("k", "id"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    found = [json.loads(x) for p in (tmp_path / "out").glob("part-*") for x in p.read_text().splitlines()]
    assert sorted((x["k"], x["id"]) for x in found) == [("a", 1), ("b", 2)]


def test_touched_keys_are_recomputed(spark, tmp_path):
    stream = feed(spark, tmp_path, [rows(("a", 0, 1), ("a", 1, 2)), rows(("b", 1, 2))])
    seen = []
    flows.touched(stream, "k", lambda keys: seen.append(sorted(r.k for r in keys.collect())), str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(tuple, seen)) == [("a",), ("b",)]


def test_rejoined(spark, tmp_path):
    shown = feed(spark, tmp_path, [rows(("a", 30, 1), ("b", 30, 2))], "shown").toDF("k", "shown_at", "shown_id")
    seen = feed(spark, tmp_path, [rows(("a", 15, 7), ("a", 1, 8), ("b", 31, 9))], "seen").toDF("k", "seen_at", "seen_id")
    assert [(r.shown_id, r.seen_id) for r in drained(flows.rejoined(shown, seen, "k"), tmp_path, "rejoined")] == [(1, 7)]


def test_windowed_counts_are_final(spark, tmp_path):
    stream = feed(spark, tmp_path, [rows(("a", 0, 1), ("a", 5, 2)), rows(("a", 500, 3))])
    got = drained(flows.counted(stream, "at", "1 minute", "10 seconds", ["k"]), tmp_path, "counted")
    assert [(r.k, r.n) for r in got] == [("a", 2)]
