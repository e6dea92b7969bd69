"""Helpers that the corpus operators share: durable intermediate tables and word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --------------------------------------------------------------------------- durable tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only where the session names none and runs in one process (tests, a laptop) is a temporary folder set; on a cluster
    executors could not see it, so a session without the setting is refused.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, folders: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back; ``folders`` are its last columns, each value a folder.

    The result has no lineage beyond the written files, so a lost executor costs a re-read and not a
    recomputation of everything before.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.partitionBy(*folders).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the files of a materialized table that nothing reads any more."""
    path = getattr(df, "_written_at", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def lent(spark: SparkSession, value: object):
    """A broadcast for the jobs of a block. The driver and every executor keep a file of it, which goes with the block."""
    held = spark.sparkContext.broadcast(value)
    try:
        yield held
    finally:
        held.destroy(blocking=True)


@contextmanager
def brief_shuffles(spark: SparkSession):
    """In the block, the shuffle files of a query go when it ends, not when the driver happens to collect its garbage.

    For queries that run once, on tables that are written.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def ticket(name: str, key: Column) -> Column:
    """63 bits drawn for a key by a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(name), key), 1)


def last_ticket(most: int, n: int) -> int:
    """The largest ticket to take so that about ``most`` of n rows are taken, all if there are no more, whatever n is."""
    return min((1 << 63) - 1, (most << 63) // max(n, 1))


#: Tasks that add up the vectors of partitions.
SUMS = 4


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for packed in batch.column(0):
            mine = np.frombuffer(packed.as_buffer(), np.float64)
            total = mine if total is None else total + mine
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])


def added_up(vectors: DataFrame, size: int) -> np.ndarray:
    """The sum of a column of packed doubles, ``size`` a row; tasks add up what partitions bring, the driver adds SUMS rows."""
    rows = vectors.repartition(SUMS).mapInArrow(_added, "sums binary").collect()
    return sum((np.frombuffer(r.sums, np.float64) for r in rows), np.zeros(size))


# --------------------------------------------------------------------------- texts in Arrow batches


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null texts count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(at):
        at = np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body, at


def row_slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes each; a longer row stands alone."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def row_pieces(batch: pa.RecordBatch, text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``most`` bytes of text, so that numpy temporaries stay small."""
    _, at = text_bytes(batch.column(batch.schema.get_field_index(text)))
    for lo, hi in row_slices(at, most):
        yield batch.slice(lo, hi - lo)
    pa.default_memory_pool().release_unused()  # workers live on, and what they keep counts


# --------------------------------------------------------------------------- word hashes

#: The six bytes that separate words: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

BLOCK = 1 << 18
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, BLOCK + 1), _powers(_BASE_INVERSE, BLOCK + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _windowed(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position-free polynomial hash of values[start:end] for every pair, at most BLOCK values."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _UP[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * _DOWN[starts]


def words_of(body: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts and ends as byte positions in ``body``, and where each row's words begin (n + 1 values).

    Words are the longest runs without the bytes that ``breaks`` marks; no word crosses a row.
    """
    lo, hi = int(offsets[0]), int(offsets[-1])
    if hi == lo:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~breaks[body[lo:hi]]
    before = np.empty_like(solid)
    before[0], before[1:] = False, solid[:-1]
    edges = offsets[:-1] - lo
    edges = edges[edges < hi - lo]
    before[edges] = False
    after = np.empty_like(solid)
    after[-1], after[:-1] = False, solid[1:]
    last = offsets[1:] - lo - 1
    after[last[last >= 0]] = False
    starts = np.flatnonzero(solid & ~before) + lo
    ends = np.flatnonzero(solid & ~after) + lo + 1
    return starts, ends, np.searchsorted(starts, offsets, side="left")


def hash_spans(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span (spans in order, none overlapping)."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = int(np.searchsorted(ends, base + BLOCK, side="right"))
        if j <= i:  # one span longer than a block
            h = np.uint64(0)
            for a in range(base, int(ends[i]), BLOCK):
                b = min(a + BLOCK, int(ends[i]))
                part = _windowed(_BYTE[body[a:b]], np.array([0]), np.array([b - a]))[0]
                h = mix(np.array([h ^ part], np.uint64))[0]
            out[i] = h
            i += 1
            continue
        values = _BYTE[body[base : int(ends[j - 1])]]
        out[i:j] = _windowed(values, starts[i:j] - base, ends[i:j] - base)
        i = j
    return mix(out ^ (ends - starts).astype(np.uint64))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for ranges that may overlap; starts and ends both ascend.

    No range may hold more than BLOCK values.
    """
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = int(np.searchsorted(ends, base + BLOCK, side="right"))
        out[i:j] = _windowed(values[base : int(ends[j - 1])], starts[i:j] - base, ends[i:j] - base)
        i = j
    return mix(out ^ (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k consecutive word hashes: len(words) - k + 1 values."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    step = BLOCK - k
    for a in range(0, n, step):
        b = min(a + step, n)
        at = np.arange(b - a)
        out[a:b] = _windowed(words[a : b + k - 1], at, at + k)
    return mix(out)
