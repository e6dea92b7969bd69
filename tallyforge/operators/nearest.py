"""Nearest signatures by tables of their parts, and nearest neighbours by cells."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.hamming import combined, distance
from .blocks import columns_of, meet
from .rank import top_per_key
from .tables import dropped, written

#: Bits of a band; there are at most 2^16 values a band, so tables over them have a fixed size.
BAND = 16
#: Radii that are probed together, as long as that costs less than a scan.
STEPS = ((0, 1, 2), (3,), (4,), (5,), (6,), (7,))
#: Queries and rows of a piece of the scan, and pairs that it scores at once.
BLOCK, ROWS, PAIRS = 2_048, 1 << 15, 1 << 20
#: Rows that a scan passes in the time of one probe, or of one pair that a probe meets; scans below so many rows cost as those.
DEAR, LEAST = 64, 1 << 17


def _bands(signature: Column, words: int) -> list[Column]:
    """The 16-bit parts of an array of longs."""
    return [F.shiftrightunsigned(signature[w], BAND * i).bitwiseAND(F.lit((1 << BAND) - 1)).cast("int") for w in range(words) for i in range(64 // BAND)]


def _by_band(df: DataFrame, art: str, full: str, words: int) -> DataFrame:
    parts = [*_bands(F.col(art), words), *_bands(F.col(full), words)]
    return df.select("*", F.posexplode(F.array(*parts)).alias("band", "part"))


def _first(found: DataFrame, k: int, distinct: str | None, ties: str) -> DataFrame:
    if distinct:
        found = found.groupBy("query_id", distinct).agg(F.min_by("id", F.struct("score", "id")).alias("id"), F.min("score").alias("score"))
    return top_per_key(found, ["query_id"], [F.col("score"), F.col(ties)], k)


def _scan(asked: pa.Table, held: pa.Table, words: int, k: int, distinct: str | None, reached: int) -> pa.Table:
    """Of each query the rows (or values of ``distinct``) of a piece that can be among its k best, each value's best row."""
    names = ["query_id", "id", "score", *([distinct] if distinct else [])]
    part = lambda i, j, score: pa.table([asked.column("query_id").take(pa.array(i)), held.column("id").take(pa.array(j)), pa.array(score), *([held.column(distinct).take(pa.array(j))] if distinct else [])], names)
    none = np.zeros(0, np.int64)
    if not asked.num_rows or not held.num_rows:
        return part(none, none, np.zeros(0))
    asked, held = asked.combine_chunks(), held.sort_by([(c, "ascending") for c in ([distinct] if distinct else []) + ["id"]]).combine_chunks()
    bits = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, words)
    both = pa.concat_arrays([asked.column("query_id").combine_chunks(), held.column("id").combine_chunks()]).dictionary_encode().indices.to_numpy()
    me, other = both[: asked.num_rows], both[asked.num_rows :]
    sides = [(bits(asked, f"q_{c}"), bits(held, c)) for c in ("art", "full")]
    bonus = held.column("bonus").to_numpy()
    if distinct:
        value = held.column(distinct).combine_chunks().dictionary_encode("encode").indices.to_numpy()
        starts = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
        nth = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(value)]))
    found, step = [], max(1, PAIRS // held.num_rows)
    for at in range(0, asked.num_rows, step):
        here, counts = slice(at, at + step), []
        near = me[here, None] == other
        for q, r in sides:
            count = np.zeros(near.shape, np.uint16)
            apart = np.full(near.shape, 16, np.uint8) if reached >= 0 else None
            for w in range(words):
                x = q[here, w, None] ^ r[:, w]
                count += np.bitwise_count(x)
                if apart is not None:
                    np.minimum(apart, np.bitwise_count(x.view(np.uint16)).reshape(*x.shape, 4).min(axis=2), out=apart)
            counts.append(count)
            if apart is not None:
                near |= apart <= reached  # met before
        score = counts[0] + 0.5 * counts[1] - bonus
        score[near] = np.inf
        if distinct:
            best = np.minimum.reduceat(score, starts, axis=1)
            kth = np.partition(best, k - 1, axis=1)[:, k - 1, None] if best.shape[1] > k else np.inf
            i, j = np.nonzero(score == np.where((best <= kth) & np.isfinite(best), best, np.nan)[:, nth])
            first = np.r_[True, (np.diff(i) > 0) | (np.diff(nth[j]) > 0)][: len(i)]  # rows are in order of value, then id
        else:
            kth = np.partition(score, k - 1, axis=1)[:, k - 1, None] if score.shape[1] > k else np.inf
            i, j = np.nonzero((score <= kth) & np.isfinite(score))
            order = np.lexsort((j, score[i, j], i))
            i, j = i[order], j[order]
            first = np.arange(len(i)) - np.searchsorted(i, i) < k
        i, j = i[first], j[first]
        found.append((i + at, j, score[i, j]))
    return part(*(np.concatenate(x) for x in zip(*found, strict=True)))


def nearest(rows: DataFrame, queries: DataFrame, k: int, distinct: str | None = None, words: int = 1, report: list | None = None, ties: str = "id") -> DataFrame:
    """The k best other rows of each query (query_id, id, score, rank and ``distinct``), by score, then id.

    ``rows`` has id, art and full (arrays of ``words`` longs) and bonus (null: 0), ``queries`` id, art and full. With
    ``distinct``, a column of the rows, the k best values of it, each with its best row; ``ties`` (id or that column)
    then orders values of one score.

    Rows are indexed by every 16-bit part of both signatures. Queries probe the parts within a growing radius r, until
    their result is sure: a row not met within r differs in more than r bits of every part, so its score is at least
    1.5 * parts * (r + 1) less the largest bonus, and a k-th best score below that is final. A pair counts at its nearest
    part only, so it is scored once. A radius whose probes and the rows that they meet cost more than a scan ends this: the
    queries left meet all rows not met, block by block inside tasks, as they have nothing near. A block gives only what
    can be among the k best. Of equal rows only as many as can be among the best take part. ``report`` gets a step's (radius, pairs scored, queries left after it).

    Rows with a signature that is null, short or holds null take no part. Queries that meet no row are not in the result.
    """
    whole = lambda c: (F.size(c) == words) & ~F.exists(c, lambda x: x.isNull())
    extra = [distinct] if distinct else []
    copies = [F.col(c) for c in ("art", "full", "bonus", *extra)]
    # signatures may be dear to make: they are written before anything, filters too, looks at them
    given = written(rows.select("id", "art", "full", F.coalesce(F.col("bonus").cast("double"), F.lit(0.0)).alias("bonus"), *extra))
    held = written(top_per_key(given.where(whole("art") & whole("full")), copies, [F.col("id")], 2 if distinct else k + 1, "__copy").drop("__copy"))
    most, size = held.agg(F.max("bonus"), F.count(F.lit(1))).first()
    index = written(_by_band(held, "art", "full", words))
    asked = written(queries.select(F.col("id").alias("query_id"), F.col("art").alias("q_art"), F.col("full").alias("q_full")))
    left = asked.where(whole("q_art") & whole("q_full"))
    masks = rows.sparkSession.range(1 << BAND).select(F.col("id").cast("int").alias("mask"), F.bit_count("id").alias("bits"), F.lit(1).alias("one"))
    parts = 64 // BAND * words
    pairs = [F.bit_count(x.bitwiseXOR(y)) for side in ("art", "full") for x, y in zip(_bands(F.col(side), words), _bands(F.col(f"q_{side}"), words), strict=True)]
    apart = F.array(*pairs)
    score = combined(distance(F.col("art"), F.col("q_art")), distance(F.col("full"), F.col("q_full")), F.col("bonus"))
    best, done, old, reached = None, [], [given, asked, held, index], -1

    def ranked_so_far(met: DataFrame) -> tuple[DataFrame, Observation]:
        """The best of what was met now and before, as a written table."""
        counted = Observation()
        found = met.observe(counted, F.count(F.lit(1)).alias("n")).select("query_id", "id", score.alias("score"), *extra)
        ranked = written(_first(found if best is None else found.unionByName(best), k, distinct, ties).select("query_id", "id", "score", *extra, "rank"))
        return ranked, counted

    for step in STEPS:
        if sum(math.comb(BAND, r) for r in step) * 2 * parts * (1 + size / (1 << BAND)) * DEAR > max(size, LEAST * words):
            break
        near = masks.where(F.col("bits").isin(*step))  # at most 65,536 rows
        probes = _by_band(left, "q_art", "q_full", words).withColumn("one", F.lit(1)).join(F.broadcast(near), "one")
        probes = probes.select("query_id", "q_art", "q_full", "band", F.col("part").bitwiseXOR(F.col("mask")).alias("part"), "bits")
        met = probes.join(index, ["band", "part"]).where("id <> query_id").withColumn("apart", apart)
        met = met.where((F.array_min("apart") == F.col("bits")) & (F.array_position("apart", F.array_min("apart")) == F.col("band") + 1))
        reached = step[-1]
        ranked, counted = ranked_so_far(met)
        sure = ranked.where((F.col("rank") == k) & (F.col("score") < 1.5 * parts * (reached + 1) - (most or 0.0))).select("query_id")
        done.append(ranked.join(sure, "query_id", "left_semi"))
        best = ranked.join(sure, "query_id", "left_anti").drop("rank")
        old.append(left)
        left = written(left.join(sure, "query_id", "left_anti"))
        n = left.count()
        if report is not None:
            report.append((reached, counted.get["n"], n))
        if not n:
            break
    n = left.count()
    if n or not done:
        if report is not None:
            pairs_left = held.crossJoin(F.broadcast(left)).where((F.col("id") != F.col("query_id")) & (F.array_min(apart) > reached))
            report.append((BAND, pairs_left.count(), 0))
        run = lambda x, y: _scan(x, y, words, k, distinct, reached)
        kind = asked.schema["query_id"].dataType.simpleString()
        one, two = (df.withColumn("one", F.lit(1)) for df in (left.withColumnRenamed("query_id", "id"), held))
        met = meet(one.withColumn("query_id", F.col("id")), two, ["one"], "id", run, f"query_id {kind}, {columns_of(held, ['id'])}, score double" + (f", {columns_of(held, extra)}" if extra else ""), BLOCK, ROWS)
        done.append(_first(met if best is None else met.unionByName(best), k, distinct, ties).select("query_id", "id", "score", *extra, "rank"))
        done[-1] = written(done[-1])
    dropped(*old, left)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def nearest_in_two_stages(rows: DataFrame, queries: DataFrame, k: int, rerank: Column, factor: int = 3) -> DataFrame:
    """The best ``factor * k`` by score, ranked again by ``rerank`` (of query_id, id and score) added, then the best k."""
    first = nearest(rows, queries, factor * k).withColumnRenamed("rank", "first")
    return top_per_key(first.withColumn("final", F.col("score") + rerank), ["query_id"], [F.col("final"), F.col("id")], k)


def _near(a: pa.Table, b: pa.Table, group: str, reach: float, k: int) -> pa.Table:
    """Of each point of a piece the k nearest others of the other piece within reach."""
    names = [group, "id", "x", "y", "other", "ox", "oy", "distance"]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if a.num_rows and b.num_rows:
        a, b = a.combine_chunks(), b.sort_by("other").combine_chunks()
        x, y, ox, oy = (t.column(c).to_numpy() for t, c in ((a, "x"), (a, "y"), (b, "ox"), (b, "oy")))
        ids = pa.concat_arrays([a.column("id").combine_chunks(), b.column("other").combine_chunks()]).dictionary_encode().indices.to_numpy()
        me, other = ids[: len(x)], ids[len(x) :]
        step = max(1, PAIRS // len(ox))
        for at in range(0, len(x), step):
            here = slice(at, at + step)
            apart = np.hypot(ox - x[here, None], oy - y[here, None])
            apart[(me[here, None] == other) | (apart > reach)] = np.inf
            kth = np.partition(apart, k - 1, axis=1)[:, k - 1, None] if apart.shape[1] > k else np.inf
            i, j = np.nonzero((apart <= kth) & np.isfinite(apart))
            order = np.lexsort((j, apart[i, j], i))
            i, j = i[order], j[order]
            first = np.arange(len(i)) - np.searchsorted(i, i) < k
            found.append((i[first] + at, j[first], apart[i[first], j[first]]))
    i, j, apart = (np.concatenate(z) for z in zip(*found, strict=True))
    i, j = pa.array(i), pa.array(j)
    return pa.table([*(a.column(c).take(i) for c in (group, "id", "x", "y")), *(b.column(c).take(j) for c in ("other", "ox", "oy")), pa.array(apart)], names)


def neighbours(points: DataFrame, group: str, reach: float, k: int) -> DataFrame:
    """Up to k nearest other points of the same group within ``reach`` (points: group, id, x, y).

    Points meet through a grid of cells of the reach's size, so only near cells are compared, not whole groups; cells are
    compared block by block inside tasks, and a block gives at most k rows for each of its points.
    """
    cell = lambda c: F.floor(F.col(c) / reach)
    given = points.where(F.col(group).isNotNull() & F.col("id").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull())
    a = given.select(group, "id", "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    near = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    b = a.select(group, F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), "cx", "cy")
    b = b.withColumn("dx", near).withColumn("dy", near).select(group, "other", "ox", "oy", (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"), F.col("other").alias("id"))
    kind = a.schema["id"].dataType.simpleString()
    met = meet(a, b, [group, "cx", "cy"], "id", lambda x, y: _near(x, y, group, reach, k), f"{columns_of(a, [group, 'id', 'x', 'y'])}, other {kind}, ox double, oy double, distance double")
    return top_per_key(met, [group, "id"], [F.col("distance"), F.col("other")], k)
