"""Importance resampling towards a target text: array-scored weights, then a distributed LSD radix sort.

Texts become hashed counts of word runs. What a bucket of hashes is worth follows from two arrays of counts, of all
documents and of the target; a document's weight is the mean worth of its runs, and a noise drawn from its id turns the
order by weight into a sample without replacement (the largest of weight plus Gumbel noise).

The order comes from a least significant digit radix sort over the composite key (score down, doc_id up). Rows lie in
blocks; a pass counts the digits of each block, the sums of these counts over all smaller digits and earlier blocks are
where each block's rows of a digit begin, and a row's destination is that offset plus its place among the rows of the
same digit in its block. After the last pass the destinations are the ranks. Every pass is a written table, so that a
lost executor costs a re-read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import added_up, discard, materialize, row_pieces, text_bytes, words_of

BUCKETS = 10_000
#: Words of the runs that are features, at most.
RUN = 2
#: A document takes part in the draw from this many words on.
LEAST_WORDS = 20
#: Per cent of the documents that take part which are drawn.
DRAWN = 25
SEED = 7

#: Bits of a digit.
DIGIT = 11
#: Blocks at most, so that a pass has BLOCKS x 2^DIGIT offsets (16 MB) whatever the number of rows.
BLOCKS = 1024
#: Rows of a block while there are fewer blocks.
BLOCK_ROWS = 1 << 14

#: Bytes that belong to no word; A-Z count as a-z.
BREAKS = np.ones(256, bool)
BREAKS[48:58] = BREAKS[97:123] = BREAKS[128:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Texts of more bytes are counted in pieces that end between words.
PIECE = 1 << 20

# --------------------------------------------------------------------------- CRC-32 of many words at once

#: Words up to this length are summed byte by byte for all words together, longer ones on their own.
_SHORT = 64
_STEP = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _STEP = np.where(_STEP & 1, (_STEP >> 1) ^ np.uint32(0xEDB88320), _STEP >> 1)


def _shifts() -> np.ndarray:
    """[length, byte of the sum, its value]: what that byte becomes after ``length`` zero bytes."""
    out = np.empty((_SHORT + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(_SHORT):
        out[n + 1] = _STEP[out[n] & 255] ^ (out[n] >> 8)
    return out


_SHIFTS = _shifts()


def crc_words(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each span of ``body``."""
    size = ends - starts
    out = np.empty(len(starts), np.uint32)
    order = np.argsort(np.minimum(size, _SHORT + 1).astype(np.uint8), kind="stable")[::-1]
    n_long = int(np.count_nonzero(size > _SHORT))
    for i in order[:n_long]:
        out[i] = zlib.crc32(body[starts[i] : ends[i]])
    order = order[n_long:]
    sums, at, size = np.full(len(order), 0xFFFFFFFF, np.uint32), starts[order], size[order]
    for p in range(int(size[0]) if len(size) else 0):
        k = int(np.searchsorted(-size, -p, side="left"))  # spans longer than p stand first
        sums[:k] = _STEP[(sums[:k] ^ body[at[:k] + p]) & 255] ^ (sums[:k] >> 8)
    out[order] = ~sums
    return out


def crc_joined(first: np.ndarray, second: np.ndarray, body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of first word, space, second word, from both CRCs and the second words' spans."""
    left = ~first
    left = ~(_STEP[(left ^ 32) & 255] ^ (left >> 8))
    size = np.minimum(ends - starts, _SHORT)
    out = second.copy()
    for k in range(4):
        out ^= _SHIFTS[size, k, (left >> np.uint32(8 * k)) & 255]
    for i in np.flatnonzero(ends - starts > _SHORT):
        out[i] = zlib.crc32(body[starts[i] : ends[i]], int(left[i]))
    return out


# --------------------------------------------------------------------------- features


def _pieces(body: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, bool]]:
    """(bytes, offsets, first row, does it go on): rows together, or a long row cut between words."""
    if len(offsets) > 2 or offsets[-1] - offsets[0] <= PIECE:
        yield body, offsets, 0, False
        return
    lo, end = int(offsets[0]), int(offsets[-1])
    on = False
    while lo < end:
        hi = min(lo + PIECE, end)
        while hi < end:  # to the next byte that belongs to no word
            gap = np.flatnonzero(BREAKS[LOWER[body[hi : min(hi + PIECE, end)]]])
            if len(gap):
                hi += int(gap[0])
                break
            hi = min(hi + PIECE, end)
        yield body, np.array([lo, hi]), 0, on
        lo, on = hi, True


def features(batches: Iterator[pa.RecordBatch], each) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """For slices of rows: the sums over their rows of ``each(row of feature, bucket of feature, rows)``, a list of arrays,
    and first the number of words and of features of each row."""
    for batch in batches:
        for part in row_pieces(batch, "text", PIECE):
            body, offsets = text_bytes(part.column(part.schema.get_field_index("text")))
            n, sums, last = part.num_rows, None, None
            for whole, at, _, on in _pieces(body, offsets):
                low = LOWER[whole[at[0] : at[-1]]]
                starts, ends, rows = words_of(low, at - at[0], BREAKS)
                crc = crc_words(low, starts, ends)
                row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
                same = np.flatnonzero(row[1:] == row[:-1]) + 1
                pairs = crc_joined(crc[same - 1], crc[same], low, starts[same], ends[same])
                of, hashes = [row, row[same]], [crc, pairs]
                if on and last is not None and len(crc):
                    of.append(row[:1])
                    hashes.append(crc_joined(last, crc[:1], low, starts[:1], ends[:1]))
                if len(crc):
                    last = crc[-1:]
                of, hashes = np.concatenate(of), np.concatenate(hashes)
                mine = [np.bincount(row, minlength=n), np.bincount(of, minlength=n), *each(of, (hashes % np.uint32(BUCKETS)).astype(np.int64), n)]
                sums = mine if sums is None else [a + b for a, b in zip(sums, mine, strict=True)]
            yield part, sums


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS)
    for _, sums in features(batches, lambda of, bucket, n: [np.bincount(bucket, minlength=BUCKETS)]):
        total += sums[2]
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Occurrences of features by bucket over all rows of the column text, exact up to 2^53."""
    return added_up(texts.select(F.col("text").cast("string").alias("text")).mapInArrow(_counted, "sums binary"), BUCKETS)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket is worth, in thousandths of a natural log."""
    s, t = source.sum() + BUCKETS, target.sum() + BUCKETS
    return np.floor(1000 * np.log((target + 1) * s / ((source + 1) * t)))


def _weighed(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (words, n, total) in features(batches, lambda of, bucket, rows: [np.bincount(of, gain[bucket], rows)]):
            weight = np.where(n > 0, total.astype(np.int64) // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x.astype(np.int64)) for x in (words, n, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return run


# --------------------------------------------------------------------------- the sort


def _digit(shift: int, low_bits: int) -> Column:
    """DIGIT bits of the composite key from bit ``shift`` on; ``low`` has the lower ``low_bits``, ``high`` the rest."""
    if shift >= low_bits:
        out = F.shiftrightunsigned("high", shift - low_bits)
    else:
        out = F.shiftrightunsigned("low", shift)
        if low_bits - shift < DIGIT:
            out = out.bitwiseOR(F.shiftleft("high", low_bits - shift))
    return out.bitwiseAND(F.lit((1 << DIGIT) - 1)).cast("int")


def _moved(offsets: np.ndarray, width: int):
    """Rows by block, each block in order: every row to its destination, which is a place in a block of ``width`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free: dict[int, np.ndarray] = {}
        for batch in batches:
            block, digit = (batch.column(i).to_numpy() for i in (0, 1))
            dest = np.empty(len(block), np.int64)
            cuts = np.flatnonzero(np.diff(block)) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(block)], strict=True) if len(block) else ():
                at = int(block[lo])
                if at not in free:
                    free = {at: offsets[:, at].copy()}  # a block is through when the next begins
                mine = digit[lo:hi]
                order = np.argsort(mine, kind="stable")
                n = np.bincount(mine, minlength=len(offsets))
                nth = np.arange(hi - lo) - np.repeat(np.cumsum(n) - n, n)
                dest[lo + order] = free[at][mine[order]] + nth
                free[at] += n
            yield pa.RecordBatch.from_arrays([pa.array((dest // width).astype(np.int32)), pa.array(dest), *(batch.column(i) for i in (2, 3, 4))], ["block", "place", "high", "low", "at"])

    return run


def radix_sorted(rows: DataFrame, n: int, high_bits: int, low_bits: int) -> DataFrame:
    """(at, place): the place from 0 of each of the ``n`` rows in ascending order of (high, low), both unsigned.

    ``at`` tells rows apart: their partition in bits 33 and up and their number in it below. Equal keys keep the order of
    their first table.
    """
    blocks = max(1, min(BLOCKS, -(-n // BLOCK_ROWS)))
    width = -(-max(n, 1) // blocks)
    rows = rows.select(F.pmod(F.shiftrightunsigned("at", 33), F.lit(blocks)).cast("int").alias("block"), F.col("at").alias("place"), "high", "low", "at")
    before = None
    for shift in range(0, max(high_bits + low_bits, 1), DIGIT):
        keyed = rows.withColumn("digit", _digit(shift, low_bits))
        found = keyed.groupBy("block", "digit").count().toArrow()  # BLOCKS x 2^DIGIT rows at most
        counts = np.zeros((1 << DIGIT, blocks), np.int64)
        counts[found["digit"].to_numpy(), found["block"].to_numpy()] = found["count"].to_numpy()
        offsets = (np.cumsum(counts.ravel()) - counts.ravel()).reshape(counts.shape)
        dealt = keyed.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "place").select("block", "digit", "high", "low", "at")
        rows = materialize(dealt.mapInArrow(_moved(offsets, width), "block int, place long, high long, low long, at long"), "pass")
        if before is not None:
            discard(before)
        before = rows
    return rows.select("at", "place")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a SHA-256 of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = DRAWN, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs`` (doc_id, text) for a ``target`` (text).

    Drawn are floor(percent x N / 100) of the N rows with at least ``least_words`` words, by score down and doc_id up;
    rank counts them from 1 and is null for all others. A null or empty text has no features and weight 0. A row without
    doc_id has no noise: its score and rank are null, and it does not count in N, though its text counts as a document's.
    Rows that repeat a doc_id are rows of their own; ties in score and doc_id go to either. An empty target or table gives
    weights from the counts that are left. Other columns are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gain = gains(bucket_counts(texts), bucket_counts(target))
    scored = texts.mapInArrow(_weighed(gain), "doc_id long, n_words long, n_features long, weight long")
    scored = materialize(scored.withColumns({"score": F.col("weight") + noise(F.col("doc_id"), seed), "at": F.monotonically_increasing_id()}), "weights")
    taking = scored.where((F.col("n_words") >= least_words) & F.col("doc_id").isNotNull())
    n, most, least, first, last = taking.agg(F.count(F.lit(1)), F.max("score"), F.min("score"), F.min("doc_id"), F.max("doc_id")).first()
    out = ["doc_id", "n_features", "weight", "score"]
    if not n:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    near = last - first < 1 << 63
    low = F.col("doc_id") - F.lit(first) if near else F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63)))
    keys = taking.select((F.lit(most) - F.col("score")).alias("high"), low.alias("low"), "at")
    places = radix_sorted(keys, n, (most - least).bit_length(), (last - first).bit_length() if near else 64)
    ranks = places.where(F.col("place") < percent * n // 100).select("at", (F.col("place") + 1).alias("rank"))
    return scored.join(ranks.hint("merge"), "at", "left").select(*out, "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: documents drawn towards the benchmark's texts."""
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_BYTES = "list_transform(range(octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), (2 * i + 1)::BIGINT, 2))::BIGINT)"
SQL = rf"""
WITH said AS (
  SELECT doc_id, false AS goal, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT item_id, true, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
),
parts AS (SELECT doc_id, goal, unnest(list_concat(w, list_transform(range(len(w) - 1), lambda i: w[i + 1] || ' ' || w[i + 2]))) AS f FROM said),
per_doc AS (SELECT doc_id, goal, f, count(*) AS c FROM parts GROUP BY ALL),
crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS step),
bucket AS (
  SELECT f, xor(list_reduce({_BYTES}, lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS b
  FROM (SELECT DISTINCT f FROM per_doc), crc
),
held AS (SELECT b, sum(c) FILTER (NOT goal) AS s, sum(c) FILTER (goal) AS t FROM per_doc JOIN bucket USING (f) GROUP BY b),
total AS (SELECT coalesce(sum(s), 0) AS big_s, coalesce(sum(t), 0) AS big_t FROM held),
gain AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (big_s + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (big_t + 10000)::DOUBLE))) AS g FROM held, total),
weighed AS (SELECT doc_id, sum(c)::BIGINT AS n_features, floor(sum(c * g) / sum(c))::BIGINT AS weight FROM per_doc JOIN bucket USING (f) JOIN gain USING (b) WHERE NOT goal GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(w) AS n, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM said LEFT JOIN weighed USING (doc_id) WHERE NOT goal
),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 25 * placed.n // 100 THEN r END AS rank FROM scored LEFT JOIN placed USING (doc_id)
"""
