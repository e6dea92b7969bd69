"""Streaming sources and sinks around the batch operators; each takes and returns DataFrames that may be streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark, path: str, schema: str, files: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, so many files a batch (the only back-pressure a source needs)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def json_lines(df: DataFrame) -> DataFrame:
    """Each row as one JSON text, for NDJSON sinks."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_json_lines(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return json_lines(df).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def touched(df: DataFrame, key: str, recompute: Callable[[DataFrame], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Calls ``recompute`` with the keys that a batch touched; ``every`` throttles batches ("2.5 seconds")."""
    writer = df.writeStream.foreachBatch(lambda rows, _: recompute(rows.select(key).distinct())).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def ingested_once(df: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """First row of each key; state is dropped once the watermark passes."""
    return df.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def rejoined(shown: DataFrame, seen: DataFrame, key: str, window: str = "20 seconds", late: str = "1 minute") -> DataFrame:
    """Sightings that show a card again: same key, at most ``window`` after an earlier one (a stream-stream interval join).

    ``shown`` has key, shown_at and shown_id; ``seen`` has key, seen_at and seen_id.
    """
    a, b = shown.withWatermark("shown_at", late).alias("a"), seen.withWatermark("seen_at", late).alias("b")
    near = (F.col("b.seen_at") < F.col("a.shown_at")) & (F.col("b.seen_at") >= F.col("a.shown_at") - F.expr(f"INTERVAL {window}"))
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & near).select(F.col(f"a.{key}"), "shown_id", "seen_id", "shown_at", "seen_at")


def counted(df: DataFrame, at: str, width: str, late: str, keys: list[str]) -> DataFrame:
    """Counts by tumbling window, final once the watermark passes (an analogue that the usual stream tools have)."""
    rows = df.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("w.start").alias("opens"), *keys, "n")
