"""Exact top-k inner products with a bit-sliced index.

Each block of rows keeps, for every component, one bitmap per bit of its integer values. A query's score is the sum of
those bitmaps shifted by the bits of the query's components (complemented where the component is negative), added with
carry-save adders on whole bitmaps. Low-order products are left out and bound the error; the k-th best value is read off
the sum's slices from the most significant downward, a bit-sliced comparison picks every row that may reach it, and
those boundary rows are scored exactly.

The index is built once: a row for each block, with its ids, values and slices, in a table of the shared folder. Queries
are broadcast in blocks of a fixed size, and each pass streams the index past one block of them; a task keeps the best
rows of each query over all row blocks that it reads.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import discard, materialize

#: Rows of a block, about; a block and its slices are one row of the index.
ROWS = 16_384
#: Queries that one pass over the index answers; they are broadcast.
QUERIES = 4_096
#: Products of weight below 2**DROPPED are left to the exact step.
DROPPED = 5


class SlicedBlock:
    """Bit slices of an integer matrix: rows x components."""

    def __init__(self, values: np.ndarray, bits: list[int] | None = None, plain: np.ndarray | None = None) -> None:
        self.values = values
        n, parts = values.shape
        self.words = -(-n // 64)
        if plain is None:
            low = values.min(axis=0) if n else np.zeros(parts, np.int64)
            raised = (values - low).astype(np.uint64)
            bits = [int(x).bit_length() for x in (raised.max(axis=0) if n else np.zeros(parts, np.uint64))]
            padded = np.zeros((self.words * 64, parts), np.uint64)
            padded[:n] = raised
            planes = [np.packbits((padded[:, d] >> np.uint64(b) & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.uint64) for d in range(parts) for b in range(bits[d])]
            plain = np.stack(planes) if planes else np.zeros((0, self.words), np.uint64)
        self.bits, self.plain = bits, plain
        self.offset = np.cumsum([0, *bits])
        self.slices = np.concatenate([plain, ~plain])
        self.valid = np.packbits(np.arange(self.words * 64) < n, bitorder="little").view(np.uint64)

    def terms(self, query: list[int]) -> list[list[int]]:
        """For each weight 2**w, which slices the sum takes."""
        out: list[list[int]] = []
        flip = int(self.offset[-1])
        for d, c in enumerate(query):
            base, width = int(self.offset[d]) + (flip if c < 0 else 0), self.bits[d]
            for j in range(abs(c).bit_length()):
                if abs(c) >> j & 1:
                    while len(out) < j + width:
                        out.append([])
                    for b in range(width):
                        out[j + b].append(base + b)
        return out

    def sums(self, terms: list[list[int]]) -> list[np.ndarray]:
        """Slices of the sum, least significant first."""
        out, carried, w = [], [], 0
        while w < len(terms) or carried:
            rows = [self.slices[terms[w]]] if w < len(terms) and terms[w] else []
            now = np.concatenate(rows + carried) if rows or carried else np.zeros((1, self.words), np.uint64)
            carried = []
            while len(now) > 2:
                t = len(now) // 3
                a, b, c = now[:t], now[t : 2 * t], now[2 * t : 3 * t]
                half = a ^ b
                carried.append((a & b) | (half & c))
                now = np.concatenate([half ^ c, now[3 * t :]])
            if len(now) == 2:
                carried.append((now[0] & now[1])[None])
                now = (now[0] ^ now[1])[None]
            out.append(now[0])
            w += 1
        return out

    def top(self, query: np.ndarray, k: int, barred: np.ndarray, dropped: int = DROPPED) -> np.ndarray:
        """Rows that hold the k best scores and all rows tied with the last, and possibly more; never ``barred`` ones."""
        some = self.valid.copy()
        for r in barred:
            some[r // 64] &= ~(np.uint64(1) << np.uint64(r % 64))
        rows = lambda m: np.flatnonzero(np.unpackbits(m.view(np.uint8), bitorder="little"))
        if int(np.bitwise_count(some).sum()) <= k:
            return rows(some)
        terms = self.terms([int(x) for x in query])
        error = sum(len(x) << w for w, x in enumerate(terms[:dropped])) >> dropped
        slices = self.sums(terms[dropped:])
        among, sure, least = some, 0, 0
        for s in reversed(slices):
            high = among & s
            n = int(np.bitwise_count(high).sum())
            least *= 2
            if sure + n >= k:
                among, least = high, least + 1
            else:
                among, sure = among & ~s, sure + n
        least = max(0, least - error)
        above, equal = np.zeros_like(some), some
        for w in range(len(slices) - 1, -1, -1):
            if least >> w & 1:
                equal = equal & slices[w]
            else:
                above |= equal & slices[w]
                equal = equal & ~slices[w]
        return rows(above | equal)


def _matrix(vectors: pd.Series, parts: int) -> np.ndarray:
    out = np.zeros((len(vectors), parts), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _packed(rows: pd.DataFrame) -> pd.DataFrame:
    """One row: a block's ids, values and slices."""
    rows = rows.sort_values("vec_id")
    block = SlicedBlock(_matrix(rows.vector, max(1, int(rows.vector.str.len().max()))))
    binary = [np.ascontiguousarray(x).tobytes() for x in (rows.vec_id.to_numpy(np.int64), block.values, np.array(block.bits, np.int64), block.plain)]
    return pd.DataFrame([binary], columns=["ids", "rows", "bits", "slices"])


class Best:
    """The best rows of each query so far."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> None:
        self.ids, self.queries, self.k = query_ids, queries, k
        self.held: list[list[tuple[int, int]]] = [[] for _ in query_ids]

    def take(self, ids: np.ndarray, block: SlicedBlock) -> None:
        parts = block.values.shape[1]
        wanted = np.zeros((len(self.ids), parts), np.int64)
        both = min(parts, self.queries.shape[1])
        wanted[:, :both] = self.queries[:, :both]
        for i, q in enumerate(wanted):
            own = np.searchsorted(ids, self.ids[i])
            at = block.top(q, self.k, np.array([own]) if own < len(ids) and ids[own] == self.ids[i] else np.zeros(0, np.int64))
            score = block.values[at] @ q
            self.held[i] = sorted([*self.held[i], *((-int(s), int(v)) for s, v in zip(score, ids[at], strict=True))])[: self.k]

    def rows(self) -> tuple[list[int], list[int], list[int]]:
        out = [(int(q), v, -s) for q, held in zip(self.ids, self.held, strict=True) for s, v in held]
        return tuple(map(list, zip(*out, strict=True))) if out else ([], [], [])


def _search(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(*shared.value, k)
        for batch in batches:
            for i in range(batch.num_rows):
                ids, values, bits, slices = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in enumerate((np.int64, np.int64, np.int64, np.uint64)))
                best.take(ids, SlicedBlock(values.reshape(len(ids), -1), bits.tolist(), slices.reshape(int(bits.sum()), -(-len(ids) // 64))))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in best.rows()], ["query_id", "vec_id", "score"])

    return run


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, vector of longs): floor(scale * x) of each component as a double.

    Leaves out null ids, null vectors and vectors with a null or non-finite component.
    """
    raw = F.col(vector_col).cast("array<double>")
    bad = F.exists(raw, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & raw.isNotNull()).where(~bad)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(raw, lambda x: F.floor(x * scale).cast("long")).alias("vector"))


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, rows_a_block: int = ROWS, queries_a_block: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows of each query by integer inner product.

    ``vectors`` is (vec_id, vector of longs); queries are the rows whose vec_id is divisible by ``every``, candidates
    every row with another vec_id. Ties go to the smaller vec_id; with fewer than k candidates all are returned.

    Rows that repeat a vec_id count once, with the smallest of their vectors. Vectors of unequal length are filled up
    with zeros; components so large that a score might not fit a long raise ValueError. Negative ids are divisible like positive ones. Empty tables, or tables without a query, give no rows.
    """
    rows = materialize(vectors.groupBy("vec_id").agg(F.min("vector").alias("vector")), "vectors")
    size = F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double"))))
    n = rows.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("vec_id") % every == 0).alias("asked"), F.max(size).alias("top"), F.max(F.size("vector")).alias("parts")).first()
    if (n["top"] or 0) ** 2 * (n["parts"] or 0) >= 2**62:
        raise ValueError(f"components of {n['top']:g} make inner products that a long cannot hold")
    row_blocks, query_blocks = max(1, -(-n["all"] // rows_a_block)), -(-n["asked"] // queries_a_block)
    block = F.pmod(F.xxhash64("vec_id"), F.lit(row_blocks)).cast("int").alias("block")
    index = materialize(rows.select("vec_id", "vector", block).groupBy("block").applyInPandas(_packed, "ids binary, rows binary, bits binary, slices binary"), "index")
    asked = rows.where(F.col("vec_id") % every == 0)
    best = []
    for b in range(query_blocks):
        held = asked.where(F.pmod(F.xxhash64(F.lit("query"), "vec_id"), F.lit(query_blocks)) == b).toPandas()
        if len(held):
            shared = rows.sparkSession.sparkContext.broadcast((held.vec_id.to_numpy(np.int64), _matrix(held.vector, n["parts"])))
            best.append(materialize(index.mapInArrow(_search(shared, k), "query_id long, vec_id long, score long"), "best"))
            shared.destroy()
    discard(rows)
    discard(index)
    if not best:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = best[0]
    for more in best[1:]:
        found = found.unionByName(more)
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: the five best rows of every fiftieth vector."""
    return top_k(quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


SQL = """
WITH valid AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: floor(256 * x::DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  GROUP BY vec_id
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM valid q JOIN valid c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""
