"""Quality classifier by co-training a text view and a metadata view.

Both views start from the same labelled documents. In each round either view labels the unlabelled documents it is
surest of, and the other view learns from them. On labelled documents kept apart, each view is calibrated (a logistic fit
of its log odds), and a last logistic fit combines the calibrated views. All documents are then scored.

Features are computed once for every document and written; learning reads them in passes over all partitions. A pass
brings one sum of gradients and curvatures a partition, these are added up in ``SUMS`` tasks, and only the sums (some
hundred kilobytes) reach the driver, which takes Newton's step. Which documents a view has labelled follows from the
weights and thresholds of the rounds so far, so there is no table of pseudo-labels and a lost task only runs again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import gram_hashes, hash_spans, last_ticket, materialize, row_pieces, text_bytes, ticket, words_of

#: Labelled documents kept apart that calibration takes, at most; they are chosen by a hash of doc_id.
CALIBRATED = 20_000
ROUNDS = 4
#: Share of the unlabelled documents that a view labels in a round, and how sure it has to be.
GROWTH = 0.05
SURE = 0.9
#: Newton's steps of a first fit, and of one that goes on from the round before.
FIRST_STEPS, MORE_STEPS = 6, 3
#: Log odds from -30 to 30 are counted in this many bins to find a threshold.
ODDS_BINS = 6000
#: Tasks that add up the sums of partitions.
SUMS = 4
WORD_BUCKETS = 256
SOURCE_BUCKETS, LANG_BUCKETS, SIZE_BINS = 64, 32, 32
N_META = SOURCE_BUCKETS + LANG_BUCKETS + SIZE_BINS

#: Classes of bytes whose shares are features.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 11, 12, 13, 32]] = 1
_CLASS[10] = 2
_CLASS[48:58] = 3
_CLASS[65:91] = 4
_CLASS[97:123] = 5
_CLASS[128:] = 6
_CLASS[[33, 39, 44, 45, 46, 63]] = 7
N_CLASSES = 8
N_SHAPE = N_CLASSES + 4


def text_features(texts: pa.Array) -> np.ndarray:
    """Rows of hashed word shares and shape features; a text without words is all zeros."""
    body, offsets = text_bytes(texts)
    starts, ends, rows = words_of(body, offsets)
    n = len(offsets) - 1
    words = hash_spans(body, starts, ends)
    count = np.diff(rows)
    row = np.repeat(np.arange(n), count)
    out = np.zeros((n, WORD_BUCKETS + N_SHAPE), np.float32)
    out[:, :WORD_BUCKETS] = np.bincount(row * WORD_BUCKETS + (words % np.uint64(WORD_BUCKETS)).astype(np.int64), minlength=n * WORD_BUCKETS).reshape(n, -1)
    out[:, :WORD_BUCKETS] /= np.maximum(count, 1)[:, None]
    at = WORD_BUCKETS
    kinds = _CLASS[body[offsets[0] : offsets[-1]]]
    size = np.maximum(np.diff(offsets), 1)
    for k in range(N_CLASSES):
        sums = np.r_[0, np.cumsum(kinds == k)]
        out[:, at + k] = np.diff(sums[offsets - offsets[0]]) / size
    at += N_CLASSES
    order = np.lexsort((words, row))
    new = np.r_[True, (row[order][1:] != row[order][:-1]) | (words[order][1:] != words[order][:-1])] if len(row) else np.zeros(0, bool)
    out[:, at] = np.bincount(row[order][new], minlength=n) / np.maximum(count, 1)
    out[:, at + 1] = np.bincount(row, ends - starts, n) / np.maximum(count, 1) / 16
    out[:, at + 2] = np.log1p(count) / 8
    pairs = gram_hashes(words, 2)
    same = row[:-1] == row[1:] if len(row) > 1 else np.zeros(0, bool)
    held = np.unique(np.stack([row[:-1][same].astype(np.uint64), pairs[same]], 1), axis=0)[:, 0].astype(np.int64) if same.any() else np.zeros(0, np.int64)
    out[:, at + 3] = np.bincount(held, minlength=n) / np.maximum(count - 1, 1)
    out[count == 0] = 0
    return out


def _hashed(values: list[str | None], buckets: int) -> np.ndarray:
    body, offsets = text_bytes(pa.array(values, pa.string()))
    keys = hash_spans(body, offsets[:-1], offsets[1:]) if len(body) else np.zeros(len(values), np.uint64)
    out = np.zeros((len(values), buckets), np.float32)
    some = np.array([v is not None for v in values], bool)
    out[np.flatnonzero(some), (keys % np.uint64(buckets)).astype(np.int64)[some]] = 1
    return out


def meta_features(batch: pa.RecordBatch) -> np.ndarray:
    """One-hot hashed source and language, and a size bin; nulls are zeros."""
    size = batch.column(batch.schema.get_field_index("n_chars")).to_pylist()
    bins = np.zeros((batch.num_rows, SIZE_BINS), np.float32)
    for i, s in enumerate(size):
        if s is not None:
            bins[i, min(SIZE_BINS - 1, max(0, s).bit_length())] = 1
    source, lang = (_hashed(batch.column(batch.schema.get_field_index(c)).to_pylist(), b) for c, b in (("source", SOURCE_BUCKETS), ("lang", LANG_BUCKETS)))
    return np.concatenate([source, lang, bins], axis=1)


# --------------------------------------------------------------------------- learning


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 8) -> np.ndarray:
    """Weights of a penalised logistic regression, the intercept last (Newton's method)."""
    x = np.c_[x, np.ones(len(x))].astype(np.float64)
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x.astype(np.float64) @ w[:-1] + w[-1], -30, 30)


def chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def told_labels(z: list[np.ndarray], known: np.ndarray, label: np.ndarray, rounds: list[dict]) -> list[np.ndarray]:
    """For each view, the labels that the other has given it, -1 where none; ``z[r][v]`` are the log odds of round r."""
    out = [np.where(known, label, -1) for _ in range(2)]
    for odds_now, r in zip(z, rounds, strict=True):
        for v in range(2):
            free = out[1 - v] < 0
            for value in (0, 1):
                sure = odds_now[v] if value else -odds_now[v]
                out[1 - v][free & ~known & (sure >= r["least"][v][value])] = value
    return out


def threshold(counts: np.ndarray, most: float) -> float:
    """The lowest log odds, from those of SURE on, that no more than ``most`` documents reach; infinite if there is none."""
    edges = -30 + 60 * np.arange(ODDS_BINS) / ODDS_BINS
    above = np.cumsum(counts[::-1])[::-1]
    fits = np.flatnonzero((above <= most) & (edges >= np.log(SURE / (1 - SURE))))
    return float(edges[fits[0]]) if len(fits) else float("inf")


def odds_bins(z: np.ndarray) -> np.ndarray:
    return np.bincount(np.clip(np.floor((z + 30) / 60 * ODDS_BINS).astype(np.int64), 0, ODDS_BINS - 1), minlength=ODDS_BINS)


def newton_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient and curvature of the logistic loss in one vector, the intercept last."""
    x = np.c_[x, np.ones(len(x), x.dtype)].astype(np.float64)
    p = chance(np.clip(x @ w, -30, 30))
    return np.r_[x.T @ (p - y), ((x * (p * (1 - p))[:, None]).T @ x)[np.tril_indices(len(w))]]


def newton_step(sums: np.ndarray, w: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """The weights after one step on the sums."""
    n = len(w)
    ridge = np.full(n, penalty)
    ridge[-1] = 1e-6
    bend = np.zeros((n, n))
    bend[np.tril_indices(n)] = sums[n:]
    bend = bend + np.tril(bend, -1).T + np.diag(ridge)
    return w - np.linalg.solve(bend, sums[:n] + ridge * w)


#: One row of features: label -1 where unknown; ``apart`` rows calibrate and do not teach.
Part = tuple[list[np.ndarray], np.ndarray, np.ndarray]
#: Applies a function to every part of the rows and adds up the vectors it returns.
Sum = Callable[[Callable[[Part], np.ndarray]], np.ndarray]


def co_train(total: Sum, calibration: Callable[[list[np.ndarray]], tuple[np.ndarray, np.ndarray]], widths: list[int], rounds: int = ROUNDS) -> dict:
    """Weights of both views, their calibration and their combination, by sums over all rows."""
    n = total(lambda part: np.array([((part[1] == v) & (part[2] == a)).sum() for v in (0, 1) for a in (False, True)] + [(part[1] < 0).sum()]))
    good, known, pool = n[2] + n[3], n[:4].sum(), n[4]
    prior = float(good / known) if known else 0.5
    if not n[:4].all():
        return {"prior": prior}
    history: list[dict] = []
    weights = [np.zeros(w + 1) for w in widths]
    cuts = np.cumsum([0, *(len(w) + len(w) * (len(w) + 1) // 2 for w in weights)])
    for r in range(rounds + 1):
        for _ in range(MORE_STEPS if r else FIRST_STEPS):

            def step(part: Part, weights=weights) -> np.ndarray:
                views, label, apart = part
                told = told_labels([[odds(x, w) for x, w in zip(views, h["weights"], strict=True)] for h in history], label >= 0, label, history)
                use = [(t >= 0) & ~((label >= 0) & apart) for t in told]
                return np.concatenate([newton_sums(x[u], t[u], w) for x, t, u, w in zip(views, told, use, weights, strict=True)])

            sums = total(step)
            weights = [newton_step(sums[cuts[v] : cuts[v + 1]], w) for v, w in enumerate(weights)]
        if r == rounds:
            break

        def count(part: Part, weights=weights) -> np.ndarray:
            views, label, _ = part
            told = told_labels([[odds(x, w) for x, w in zip(views, h["weights"], strict=True)] for h in history], label >= 0, label, history)
            out = []
            for v, x in enumerate(views):
                z = odds(x[told[1 - v] < 0], weights[v])
                out += [odds_bins(-z), odds_bins(z)]
            return np.concatenate(out)

        bins = total(count).reshape(2, 2, ODDS_BINS)
        least = [[threshold(bins[v, value], GROWTH * pool * (prior if value else 1 - prior)) for value in (0, 1)] for v in range(2)]
        history = [*history, {"weights": weights, "least": least}]
    z, label = calibration(weights)
    if len(set(label.tolist())) < 2:
        return {"prior": prior}
    scaled = [fit(z[:, v : v + 1], label, 1e-3) for v in range(2)]
    both = np.stack([odds(z[:, v : v + 1], c) for v, c in enumerate(scaled)], 1)
    return {"prior": prior, "weights": weights, "scaled": scaled, "mixed": fit(both, label, 1e-3), "history": history}


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text features as half floats, metadata as the places of its ones; nulls and -1 for none."""
    for batch in batches:
        for piece in row_pieces(batch, "text"):
            text = text_features(piece.column(piece.schema.get_field_index("text"))).astype(np.float16)
            meta = meta_features(piece).astype(np.uint8)
            packed = [np.ascontiguousarray(x) for x in (text, np.packbits(meta, axis=1))]
            columns = [pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1] * x.itemsize), len(x), [None, pa.py_buffer(x)]).cast(pa.binary()) for x in packed]
            yield pa.RecordBatch.from_arrays([piece.column(0), *columns], ["doc_id", "text_view", "meta_view"])


def _views(batch: pa.RecordBatch) -> list[np.ndarray]:
    n = batch.num_rows
    text, meta = (b"".join(batch.column(batch.schema.get_field_index(c)).to_pylist()) for c in ("text_view", "meta_view"))
    return [
        np.frombuffer(text, np.float16).reshape(n, WORD_BUCKETS + N_SHAPE).astype(np.float32),
        np.unpackbits(np.frombuffer(meta, np.uint8).reshape(n, -1), axis=1)[:, :N_META].astype(np.float32),
    ]


#: Rows whose features are unpacked together.
UNPACKED = 8192


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Part]]:
    for batch in batches:
        for i in range(0, batch.num_rows, UNPACKED):
            part = batch.slice(i, UNPACKED)
            label, apart = (part.column(part.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("label", "apart"))
            yield part, (_views(part), label, apart)


def _sums_of(function: Callable[[Part], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, part in _parts(batches):
            mine = function(part).astype(np.float64)
            total = mine if total is None else total + mine
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for packed in batch.column(0):
            mine = np.frombuffer(packed.as_buffer(), np.float64)
            total = mine if total is None else total + mine
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])


def _plain(docs: DataFrame) -> DataFrame:
    kinds = {"doc_id": "long", "text": "string", "source": "string", "lang": "string", "n_chars": "long"}
    return docs.select(*[(F.col(c) if c in docs.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def featured(docs: DataFrame, labels: DataFrame | None = None, label_col: str = "quality") -> DataFrame:
    """doc_id, label (-1 where unknown), text_view, meta_view and apart of every row, written to the shared folder.

    Several labels of one doc_id count as their rounded mean.
    """
    columns = ["doc_id", "text", "source", "lang", "n_chars"]
    rows = _plain(docs).select(columns).mapInArrow(_feature_rows, "doc_id long, text_view binary, meta_view binary")
    if labels is None:
        rows = rows.withColumn("label", F.lit(-1))
    else:
        told = labels.select(F.col("doc_id").cast("long"), F.col(label_col).cast("double").alias("label")).where("doc_id is not null and label is not null")
        told = told.groupBy("doc_id").agg(F.round(F.avg("label")).cast("int").alias("label"))
        # features, not texts, meet the labels, by a merge at every size as both grow
        rows = rows.join(told.hint("merge"), "doc_id", "left").withColumn("label", F.coalesce("label", F.lit(-1)))
    apart = F.coalesce(F.pmod(F.xxhash64(F.lit("apart"), "doc_id"), F.lit(5)) == 0, F.lit(False))
    return materialize(rows.select("doc_id", "label", "text_view", "meta_view", apart.alias("apart")), "features")


def learn(features: DataFrame, rounds: int = ROUNDS, calibrated: int = CALIBRATED) -> dict:
    """The co-trained model of ``featured`` rows: a few hundred numbers a round. See ``score`` for nulls and repeats."""
    rows = features.select("label", "text_view", "meta_view", "apart")

    def total(function: Callable[[Part], np.ndarray]) -> np.ndarray:
        sums = rows.mapInArrow(_sums_of(function), "sums binary").repartition(SUMS).mapInArrow(_added, "sums binary").collect()
        return sum((np.frombuffer(r.sums, np.float64) for r in sums), np.zeros(1)) if sums else np.zeros(5)

    def calibration(weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        held = features.where("apart and label >= 0")
        share = ticket("calibrate", F.col("doc_id")) <= last_ticket(calibrated, held.count())
        got = held.where(share).mapInArrow(_odds_rows(weights), "z0 double, z1 double, label int").collect()
        return np.array([[r.z0, r.z1] for r in got]).reshape(-1, 2), np.array([r.label for r in got])

    return co_train(total, calibration, [WORD_BUCKETS + N_SHAPE, N_META], rounds)


def _odds_rows(weights: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (views, label, _) in _parts(batches):
            z = [pa.array(odds(x, w).astype(np.float64)) for x, w in zip(views, weights, strict=True)]
            yield pa.RecordBatch.from_arrays([*z, pa.array(label, pa.int32())], ["z0", "z1", "label"])

    return run


def _score(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, (views, _, _) in _parts(batches):
            if "weights" not in model:
                parts = [np.full(rows.num_rows, model["prior"])] * 3
            else:
                z = [odds(odds(x, w)[:, None], c) for x, w, c in zip(views, model["weights"], model["scaled"], strict=True)]
                parts = [chance(z[0]), chance(z[1]), chance(odds(np.stack(z, 1), model["mixed"]))]
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("doc_id")), *map(pa.array, parts)], ["doc_id", "p_text", "p_meta", "score"])

    return run


def score(features: DataFrame, model: dict) -> DataFrame:
    """doc_id, p_text, p_meta and score (chances of good quality, 0 to 1) for every row of ``featured`` documents.

    The documents may hold text, source, lang and n_chars; what is missing or null gives zeros for its features, so a
    null or empty text is scored by the learned intercept and the metadata. Rows that repeat a doc_id are scored one by
    one, and teach one by one. Without both kinds of label in the learning and the calibration part, every score is the
    share of good labels, or 0.5 if there is none. An empty table gives an empty result; other columns are not read.
    """
    model = {k: v for k, v in model.items() if k != "history"}
    return features.select("doc_id", "label", "text_view", "meta_view", "apart").mapInArrow(_score(model), "doc_id long, p_text double, p_meta double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the quality of all documents."""
    rows = featured(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(rows, learn(rows)).withColumn("keep", F.col("score") >= 0.5)
