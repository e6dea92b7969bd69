"""Toxicity by a convolutional text classifier over hashed word embeddings.

Words hash to buckets; buckets that enough learning documents hold have an embedding, all others are the zero vector, so
an unseen word says nothing. Filters of several widths slide over the whole text, the strongest answer of each filter is
kept (max pooling), and a logistic layer weighs these; the answers of a few such networks are averaged. Scoring runs in
tasks over all rows. The sums of a filter's taps are tables by word, so scoring adds rows of tables. Long texts are walked
in parts that overlap by a filter's width: the maximum over parts is that of the whole.

All labelled documents of the learning part teach. Their words are written once as bucket numbers. Training goes in rounds:
a round's documents are dealt to shards by a hash, each shard trains its copy of the networks in a task (minibatches,
Adagrad), and the copies are averaged, a word by how often each shard met it. Few documents are one shard, which is plain
training; with more of them each is taken fewer times, but ``LEAST_PASSES`` times at least. A shard gives only the words that
it met; these and the averages are files in the shared folder, which go when the next averages are there, and tasks read from
them what they begin with. Only the last averages, which do not grow with the documents, reach the driver.

A share of the documents is kept apart from training and sets a threshold for each language, by the fewest errors under the
true share of labels; their answers are counted in bins. The language is the one of most likely words, also learned from
all learning documents, so a score needs the text alone. A score is the logistic of the distance from the threshold: 0.5 is
where the language's threshold lies.
"""

from __future__ import annotations

import copy
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.dataset
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .resample import BREAKS, LOWER
from .shared import brief_shuffles, discard, hash_spans, lent, materialize, row_pieces, text_bytes, words_of
from .warc import opened

#: Kept apart for thresholds: one learning document in APART by hash.
APART = 3
BUCKETS = 1 << 18
#: Learning documents that a word needs for an embedding.
LEAST_DOCS = 15
DIM, WIDTHS, FILTERS = 16, (1, 2, 3), 12
BATCH, RATE, DECAY, DROP = 32, 0.08, 1e-4, 0.25
#: Rounds of training; documents up to which each is taken in every round; and in how many rounds each is taken at least.
ROUNDS, EVERY_ROUND, LEAST_PASSES = 8, 4000, 2
#: Documents of a round that a shard has, about, until there are SHARDS of them.
SHARD_DOCS, SHARDS = 2500, 16
#: Documents and words that a shard shuffles at once, words a filter walks at once, and words of a slice of a network.
BUFFER, BUFFER_WORDS, WALK, SLICE = 4096, 1 << 22, 1 << 18, 4096
#: Tasks that average slices.
MEANS = 12
#: Bits that tell which rows have no label: so many a labelled row, in blocks of BLOCK_BITS, BITS at most.
ROW_BITS, BLOCK_BITS, BITS = 16, 1 << 15, 1 << 26
#: Answers from -ODDS to ODDS are counted in bins of 1 / FINE.
ODDS, FINE = 30, 100
#: Networks from different starts whose answers are averaged.
NETS = 3
#: Documents of each label that a language needs among those kept apart to have a threshold of its own, and documents to be known.
OWN, KNOWN = 20, 20
#: Languages told apart, at most, the most frequent ones.
LANGUAGES = 64
PIECE = 1 << 19
HELD = 5

# --------------------------------------------------------------------------- words


def bucket_words(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return (hash_spans(low, starts, ends) % np.uint64(BUCKETS)).astype(np.int32)


def _cut(body: np.ndarray, at: int, end: int) -> int:
    """The first place from ``at`` on that lies between words."""
    while at < end:
        gap = np.flatnonzero(BREAKS[LOWER[body[at : min(at + PIECE, end)]]])
        if len(gap):
            return at + int(gap[0])
        at += PIECE
    return end


def listed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the words of the texts, and where each text's begin (n + 1 values)."""
    body, offsets = text_bytes(texts)
    low = LOWER[body[offsets[0] : offsets[-1]]]
    starts, ends, rows = words_of(low, offsets - offsets[0], BREAKS)
    return bucket_words(low, starts, ends), rows


def text_parts(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int, bool]]:
    """(buckets, row offsets, words of the part before, last part?): all texts at once, or one long text in parts."""
    body, offsets = text_bytes(texts)
    lo, end = int(offsets[0]), int(offsets[-1])
    if len(offsets) > 2 or end - lo <= PIECE:
        yield *listed_words(texts), 0, True
        return
    tail = np.zeros(0, np.int32)
    while lo < end:
        hi = _cut(body, lo + PIECE, end)
        low = LOWER[body[lo:hi]]
        starts, ends, _ = words_of(low, np.array([0, hi - lo]), BREAKS)
        words = np.r_[tail, bucket_words(low, starts, ends)]
        yield words, np.array([0, len(words)]), len(tail), hi == end
        tail = words[max(0, len(words) - max(WIDTHS) + 1) :]
        lo = hi


def padded(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with ``max(WIDTHS) - 1`` zeros behind each row, and the rows' new offsets; an empty row is one zero more."""
    size = np.diff(rows)
    at = np.r_[0, np.cumsum(np.maximum(size, 1) + max(WIDTHS) - 1)]
    out = np.zeros(at[-1], words.dtype)
    out[np.arange(len(words)) + np.repeat(at[:-1] - rows[:-1], size)] = words
    return out, at


# --------------------------------------------------------------------------- the network


class Network:
    """Embeddings of ``n`` words (word 0 is the zero vector), filters and the logistic layer."""

    def __init__(self, n: int, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale=1.0: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.words = draw(n, DIM, scale=0.3)
        self.words[0] = 0
        self.taps = [draw(w, DIM, FILTERS, scale=(2 / (w * DIM)) ** 0.5) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = draw(len(WIDTHS) * FILTERS, scale=0.1)
        self.level = np.zeros(1, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.words, *self.taps, *self.bias, self.out, self.level]

    def tables(self) -> list[np.ndarray]:
        """For each width, what each word adds at each tap."""
        return [np.einsum("nd,wdf->wnf", self.words, t) for t in self.taps]

    def pooled(self, ids: np.ndarray, rows: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """The strongest answer of each filter on each row of padded words."""
        gap = max(WIDTHS) - 1
        out = []
        for w, table, bias in zip(WIDTHS, tables, self.bias, strict=True):
            answer = table[0][ids[: len(ids) - gap]]
            for j in range(1, w):
                answer += table[j][ids[j : len(ids) - gap + j]]
            for g in range(gap):  # windows begin at words, not in the zeros behind a row
                answer[rows[1:-1] - 1 - g] = -np.inf
            out.append(np.maximum(np.maximum.reduceat(answer, rows[:-1], axis=0) + bias, 0))
        return np.concatenate(out, axis=1)

    def answers(self, pooled: np.ndarray) -> np.ndarray:
        return pooled.astype(np.float64) @ self.out.astype(np.float64) + float(self.level[0])

    def strongest(self, ids: np.ndarray, rows: np.ndarray, w: int, taps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each filter of a width answers most on each padded row, and how much; long rows are walked in parts."""

        def answers(lo: int, hi: int) -> np.ndarray:
            x = self.words[ids[lo : hi + w - 1]]
            return sum(x[j : hi - lo + j] @ taps[j] for j in range(w))

        ends = rows[1:] - max(WIDTHS) + 1
        whole = answers(0, len(ids) - w + 1) if len(ids) <= WALK else None
        at, best, each = np.empty((len(ends), FILTERS), np.int64), np.empty((len(ends), FILTERS), self.words.dtype), np.arange(FILTERS)
        for i, end in enumerate(ends):
            for lo in range(rows[i], end, WALK):
                hi = min(lo + WALK, end)
                answer = whole[lo:hi] if whole is not None else answers(lo, hi)
                k = answer.argmax(axis=0)
                more = (answer[k, each] > best[i]) | (lo == rows[i])
                at[i], best[i] = np.where(more, lo + k, at[i]), np.where(more, answer[k, each], best[i])
        return at, best

    def gradients(self, ids: np.ndarray, rows: np.ndarray, label: np.ndarray, weight: np.ndarray, keep: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss and gradients of all parameters on padded rows; ``keep`` scales pooled answers (dropout)."""
        n = len(rows) - 1
        places, best = [], []
        for w, taps, bias in zip(WIDTHS, self.taps, self.bias, strict=True):
            at, answer = self.strongest(ids, rows, w, taps)
            places.append(at)
            best.append(np.maximum(answer + bias, 0))
        pooled = np.concatenate(best, axis=1) * keep
        z = np.clip(pooled @ self.out + self.level[0], -30, 30)
        p = 1 / (1 + np.exp(-z))
        loss = float((weight * (np.logaddexp(0, z) - label * z)).sum() / n)
        dz = ((p - label) * weight / n).astype(np.float32)
        d_out, d_level = pooled.T @ dz, np.array([dz.sum()], np.float32)
        d_pooled = dz[:, None] * self.out * keep * (pooled > 0)
        d_words, d_taps, d_bias = np.zeros_like(self.words), [], []
        for k, (w, taps, at) in enumerate(zip(WIDTHS, self.taps, places, strict=True)):
            d = d_pooled[:, k * FILTERS : (k + 1) * FILTERS]
            d_bias.append(d.sum(axis=0))
            tap = np.empty_like(taps)
            for j in range(w):
                tap[j] = np.einsum("nfd,nf->df", self.words[ids[at + j]], d)
                np.add.at(d_words, ids[at + j].ravel(), (d[:, :, None] * taps[j].T).reshape(-1, DIM))
            d_taps.append(tap)
        d_words[0] = 0
        return loss, [d_words, *d_taps, *d_bias, d_out, d_level]


class Trainer:
    """A network, what its steps have been so far (Adagrad), and how often this trainer has met each word."""

    def __init__(self, net: Network, past: list[np.ndarray]) -> None:
        self.net, self.past = net, past
        self.met, self.docs = np.zeros(len(net.words), np.int64), 0

    def learn(self, docs: list[np.ndarray], label: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> None:
        """One pass over documents of word numbers, in drawn order; a batch touches the rows of its own words alone."""
        net, part = self.net, copy.copy(self.net)
        order = rng.permutation(len(docs))
        for i in range(0, len(order), BATCH):
            take = order[i : i + BATCH]
            ids, rows = padded(np.concatenate([docs[k] for k in take]), np.r_[0, np.cumsum([len(docs[k]) for k in take])])
            words, ids, n = np.unique(ids, return_inverse=True, return_counts=True)  # word 0 pads each row, so it comes first
            keep = (rng.random(len(net.out)) >= DROP).astype(np.float32) / (1 - DROP)
            part.words = net.words[words]
            _, (slope, *slopes) = part.gradients(ids, rows, label[take], weight[take], keep)
            self.past[0][words] += slope * slope
            net.words[words] -= RATE * slope / np.sqrt(self.past[0][words])
            for p, g, q in zip(net.parameters()[1:], slopes, self.past[1:], strict=True):
                g = g + DECAY * p
                q += g * g
                p -= RATE * g / np.sqrt(q)
            self.met[words] += n
        self.docs += len(docs)


def new_trainers(n_words: int) -> list[Trainer]:
    nets = [Network(n_words, seed) for seed in range(NETS)]
    return [Trainer(net, [np.full_like(p, 1e-6) for p in net.parameters()]) for net in nets]


def mean_answers(nets: list[Network], pooled: list[np.ndarray]) -> np.ndarray:
    return np.mean([net.answers(p) for net, p in zip(nets, pooled, strict=True)], axis=0)


def best_threshold(z: np.ndarray, label: np.ndarray, weight: np.ndarray) -> float:
    """The middle of the widest range of thresholds with the smallest weight of errors (label 1 at or above it)."""
    values = np.unique(z)
    order = np.argsort(z)
    gain = np.cumsum(np.where(label[order] > 0, weight[order], -weight[order]))  # errors if all up to here are called 0
    last = np.searchsorted(z[order], values, side="right") - 1
    errors = np.r_[0, gain[last]]
    edges = np.r_[values[0] - 2, values, values[-1] + 2]
    wide = np.where(errors <= errors.min() + 1e-9, np.diff(edges), -1)
    k = int(wide.argmax())
    return float((edges[k] + edges[k + 1]) / 2)


# --------------------------------------------------------------------------- learning and scoring


def _bit(n_bits: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(n_bits))


def marked_rows(told: DataFrame, n: int) -> np.ndarray:
    """Bits of the hashes of ``n`` doc_ids: an unset bit tells that a row is not in ``told``, a set one that it may be."""
    n_bits = min(max(1 << (ROW_BITS * n - 1).bit_length(), BLOCK_BITS), BITS)
    blocks = told.select(_bit(n_bits).alias("bit")).groupBy(F.expr(f"bit div {BLOCK_BITS}").alias("block")).agg(F.expr(f"bitmap_construct_agg(bit % {BLOCK_BITS})").alias("bits"))
    out = np.zeros((n_bits // BLOCK_BITS, BLOCK_BITS // 8), np.uint8)
    for r in blocks.collect():  # BITS at most
        out[r.block] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def _listed(marks: Broadcast):
    """(doc_id, key, lang, words) of the rows that may be labelled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column("bit").to_numpy()
            batch = batch.filter(pa.array(marks.value[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 == 1))
            for part in row_pieces(batch, "text", PIECE):
                lists = [[] for _ in range(part.num_rows)]
                for words, rows, again, _ in text_parts(part.column(part.schema.get_field_index("text"))):
                    for k, (lo, hi) in enumerate(zip(rows, rows[1:], strict=False)):
                        lists[k].append(words[lo + again : hi].tobytes())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), pa.array([b"".join(x) for x in lists], pa.binary())], ["doc_id", "key", "lang", "words"])

    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(HELD)) == 0, F.lit(False))


def _plain(docs: DataFrame) -> DataFrame:
    kinds = {"doc_id": "long", "text": "string", "lang": "string"}
    return docs.select(*[(F.col(c) if c in docs.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def learning_rows(docs: DataFrame, labels: DataFrame, label_col: str = "toxic") -> tuple[DataFrame, np.ndarray]:
    """All learning rows (key, label, lang, words, apart, turn), and how many labelled documents there are of labels 0 and 1."""
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label")).where("doc_id is not null and label is not null")
    told = told.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.round(F.avg("label")).cast("int").alias("label")).where("label in (0, 1)")
    told = materialize(told, "told")
    n = {r.label: r["count"] for r in told.groupBy("label").count().collect()}
    rows = _plain(docs).where(F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    apart, turn = F.pmod(F.shiftright("key", 7), F.lit(APART)) == 0, F.pmod(F.xxhash64("key", F.lit("turn")), F.lit(ROUNDS)).cast("int")
    marks = marked_rows(told, sum(n.values()))
    with lent(told.sparkSession, marks) as marks_there:
        rows = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "lang", "text", _bit(8 * len(marks)).alias("bit"))
        rows = rows.mapInArrow(_listed(marks_there), "doc_id long, key long, lang string, words binary")
        rows = materialize(rows.join(told, "doc_id").select("key", "label", "lang", "words", apart.alias("apart"), turn.alias("turn")), "learning")
    discard(told)
    return rows, np.array([n.get(0, 0), n.get(1, 0)], float)


def _lists(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.int32) if x.is_valid and len(x.as_buffer()) else np.zeros(0, np.int32) for x in column]


def _counted(names: list[str]):
    """(lang, bucket, docs, words) of a task's rows; languages are places in ``names``, -1 for others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, place = {}, {x: i for i, x in enumerate(names)}
        for batch in batches:
            for lang, words in zip(batch.column("lang").to_pylist(), _lists(batch.column("words")), strict=True):
                docs, all_ = sums.setdefault(place.get(lang, -1), (np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)))
                at, n = np.unique(words, return_counts=True)
                docs[at] += 1
                all_[at] += n
        for lang, (docs, all_) in sums.items():
            at = np.flatnonzero(docs)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), lang, np.int32)), pa.array(at.astype(np.int32)), pa.array(docs[at]), pa.array(all_[at])], ["lang", "bucket", "docs", "words"])

    return run


def vocabulary(rows: DataFrame) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Each bucket's word number (0: none), the languages, and the log likelihood of each word in each language."""
    langs = rows.where("lang is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    names = [r.lang for r in langs if r["count"] >= KNOWN]
    counts = rows.select("lang", "words").mapInArrow(_counted(names), "lang int, bucket int, docs long, words long")
    counts = materialize(counts.groupBy("lang", "bucket").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")), "buckets")
    known = counts.groupBy("bucket").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCS).select("bucket").toArrow()
    known = np.sort(known.column("bucket").to_numpy())  # BUCKETS at most
    number = np.zeros(BUCKETS, np.int32)
    number[known] = np.arange(1, len(known) + 1)
    likely = np.ones((len(known) + 1, len(names)))
    for k in range(len(names)):
        mine = counts.where(F.col("lang") == k).select("bucket", "words").toArrow()
        likely[:, k] += np.bincount(number[mine.column("bucket").to_numpy()], mine.column("words").to_numpy(), len(likely))
    discard(counts)
    likely = np.log(likely / likely.sum(axis=0)).astype(np.float32)
    likely[0] = 0  # unknown words tell no language
    return number, names, likely


def _trained(begin: str | None, number: Broadcast, share: np.ndarray, turn: int):
    """Trains copies of the networks on each shard of rows that come shard by shard; gives the words met, in slices, with weights.

    ``begin`` is where the averages before are written.
    """

    def slices(shard: int, mine: list[Trainer]) -> Iterator[pa.RecordBatch]:
        for k, t in enumerate(mine):
            flat = lambda x: np.concatenate([z.ravel() for z in x]).astype(np.float32)
            parts = [(-1, np.zeros(1, int), np.array([t.docs]), flat(t.net.parameters()[1:]), flat(t.past[1:]))]
            for lo in range(0, len(t.met), SLICE):
                at = np.flatnonzero(t.met[lo : lo + SLICE])
                if len(at):
                    parts.append((lo, at, t.met[lo + at], t.net.words[lo + at], t.past[0][lo + at]))
            for lo, *columns in parts:
                data = [np.ascontiguousarray(x, kind).tobytes() for x, kind in zip(columns, _KINDS.values(), strict=True)]
                yield pa.RecordBatch.from_pylist([{"net": k, "slice": lo, "shard": shard, **dict(zip(_KINDS, data, strict=True)), "part": (lo // SLICE * NETS + k) % MEANS}], _SLICES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, mine, docs, label, size = None, [], [], [], 0

        def learn() -> None:
            y = np.array(label, float)
            for k, t in enumerate(mine):
                t.learn(docs, y, 0.5 / share[y.astype(int)], np.random.default_rng([k, turn, shard, t.docs]))

        for batch in batches:
            for at, y, words in zip(batch.column("shard").to_pylist(), batch.column("label").to_pylist(), _lists(batch.column("words")), strict=True):
                if docs and (at != shard or len(docs) >= BUFFER or size >= BUFFER_WORDS):
                    learn()
                    docs, label, size = [], [], 0
                if at != shard:
                    if mine:
                        yield from slices(shard, mine)
                    shard, mine = at, trainers_of(int(number.value.max()) + 1, begin)
                docs.append(number.value[words])
                label.append(y)
                size += len(words)
        if docs:
            learn()
        if mine:
            yield from slices(shard, mine)

    return run


#: What a slice has of each word met: its place in the slice, how often it was met, its embedding and what its steps have been.
_KINDS = {"at": np.int32, "met": np.int64, "value": np.float32, "past": np.float32}
_SLICES = pa.schema([("net", pa.int32()), ("slice", pa.int32()), ("shard", pa.int32()), *((c, pa.binary()) for c in _KINDS), ("part", pa.int32())])
_SLICE_TYPES = "net int, slice int, shard int, at binary, met binary, value binary, past binary, part int"
#: The shard of averages; they come before all shards, and nothing is said of how often their words were met.
_BEFORE = -1


def _unpacked(rows: pa.Table | pa.RecordBatch, name: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), _KINDS[name]) for x in rows.column(name)]


def _put(arrays: list[np.ndarray], lo: int, at: np.ndarray, values: np.ndarray) -> None:
    """Puts a slice of words in its place; slice -1 is all but the words."""
    if lo >= 0:
        arrays[0][lo + at] = values.reshape(-1, DIM)
        return
    for p in arrays[1:]:
        p[...], values = values[: p.size].reshape(p.shape), values[p.size :]


def trainers_of(n_words: int, path: str | None) -> list[Trainer]:
    """Trainers as the averages at ``path`` have them; words that none has met yet are as drawn."""
    trainers = new_trainers(n_words)
    if path:
        there, root = opened(path)
        rows = pyarrow.dataset.dataset(root, _SLICES.remove(len(_SLICES) - 1), format="parquet", filesystem=there)
        for batch in rows.to_batches(columns=["net", "slice", "at", "value", "past"], use_threads=False):
            for k, lo, at, value, past in zip(*(batch.column(c).to_pylist() for c in ("net", "slice")), *(_unpacked(batch, c) for c in ("at", "value", "past")), strict=True):
                _put(trainers[k].net.parameters(), lo, at, value)
                _put(trainers[k].past, lo, at, past)
        pa.default_memory_pool().release_unused()
    return trainers


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The means over shards of the slices of a task, each word by how often a shard met it; words met by none stay as before."""
    rows = pa.Table.from_batches(batches, _SLICES).sort_by([(c, "ascending") for c in ("net", "slice", "shard")])
    keys = np.stack([rows.column(c).to_numpy() for c in ("net", "slice")])
    edges = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0), True]) if len(rows) else np.zeros(1, int)
    for lo, hi in zip(edges, edges[1:], strict=False):
        mine = rows.slice(lo, hi - lo)
        size, old = SLICE if keys[1, lo] >= 0 else 1, int(mine.column("shard")[0].as_py() == _BEFORE)
        places, met = _unpacked(mine, "at"), _unpacked(mine, "met")
        total, known, means = np.zeros(size, np.int64), np.zeros(size, bool), []
        for at, n in zip(places[old:], met[old:], strict=True):
            total[at] += n
        for at in places:
            known[at] = True
        for name in ("value", "past"):
            values = _unpacked(mine, name)
            mean = np.zeros((size, len(values[0]) // len(places[0])))
            for at, n, x in zip(places[old:], met[old:], values[old:], strict=True):
                mean[at] += x.reshape(len(at), -1) * (n / total[at])[:, None]
            if old:
                stay = total[places[0]] == 0
                mean[places[0][stay]] = values[0].reshape(len(stay), -1)[stay]
            means.append(mean[known].astype(np.float32).tobytes())
        row = {"net": int(keys[0, lo]), "slice": int(keys[1, lo]), "shard": _BEFORE, "met": b"", "part": mine.column("part")[0].as_py()}
        yield pa.RecordBatch.from_pylist([row | {"at": np.flatnonzero(known).astype(np.int32).tobytes(), "value": means[0], "past": means[1]}], _SLICES)


def averaged(tables: Iterable[DataFrame]) -> DataFrame:
    """The means of slices in tables that have a folder for each ``part``: a task reads one of each, nothing is shuffled."""
    parts = [reduce(DataFrame.union, [t.where(F.col("part") == k) for t in tables]).coalesce(1) for k in range(MEANS)]
    return reduce(DataFrame.union, parts).mapInArrow(_averaged, _SLICE_TYPES)


def trained(rows: DataFrame, number: np.ndarray, n: np.ndarray) -> list[Network]:
    """Networks fitted to all ``rows`` (key, label, words, turn), of which there are ``n`` of labels 0 and 1; both labels weigh alike."""
    share, spark, means = n / n.sum(), rows.sparkSession, []
    passes = int(np.clip(np.ceil(ROUNDS * EVERY_ROUND / n.sum()), LEAST_PASSES, ROUNDS))
    shards = int(np.clip(n.sum() * passes / ROUNDS // SHARD_DOCS, 1, SHARDS))
    with lent(spark, number) as numbers:
        for turn in range(ROUNDS):
            some = rows.where(F.pmod(F.col("turn") + turn, F.lit(ROUNDS)) < passes)
            some = some.select(F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(shards)).cast("int").alias("shard"), "key", "label", "words")
            dealt = some.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "key", "label")
            begin = means[0]._written_at if means else None
            parts = materialize(dealt.mapInArrow(_trained(begin, numbers, share, turn), _SLICE_TYPES), "slices", ("part",))
            before, means = means, [materialize(averaged([*means, parts]), "networks", ("part",))]
            for old in (parts, *before):
                discard(old)
    nets = [Network(int(number.max()) + 1, seed) for seed in range(NETS)]
    for batch in means[0].select("net", "slice", "at", "value").toArrow().to_batches():  # of the networks' size, BUCKETS words at most
        for k, lo, at, value in zip(*(batch.column(c).to_pylist() for c in ("net", "slice")), *(_unpacked(batch, c) for c in ("at", "value")), strict=True):
            _put(nets[k].parameters(), lo, at, value)
    discard(means[0])
    return nets


def _answered(model: Broadcast):
    """(lang, label, bin, n): a task's rows counted by likely language, label and answer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, got = with_tables(model.value), {}
        for batch in batches:
            for y, words in zip(batch.column("label").to_pylist(), _lists(batch.column("words")), strict=True):
                z, lang = _answers(ready, 1, _word_parts(words))
                k = int(lang[0]), y, int(np.floor(np.clip(z[0], -ODDS, ODDS) * FINE))
                got[k] = got.get(k, 0) + 1
        if got:
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in got], pa.int32()) for i in range(3)), pa.array(list(got.values()), pa.int64())], ["lang", "label", "bin", "n"])

    return run


def _word_parts(words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, bool]]:
    """As ``text_parts``, of one document's buckets."""
    gap = max(WIDTHS) - 1
    for lo in range(0, max(len(words), 1), WALK):
        part = words[max(0, lo - gap) : lo + WALK]
        yield part, np.array([0, len(part)]), min(lo, gap), lo + WALK >= len(words)


def level_thresholds(found: list, counts: np.ndarray, n_langs: int) -> np.ndarray:
    """The threshold of each language from rows (lang, label, bin, n) of documents kept apart."""
    lang, label, n = (np.array([r[c] for r in found]) for c in ("lang", "label", "n"))
    z = (np.array([r.bin for r in found]) + 0.5) / FINE
    weight = n * np.where(label > 0, counts[1] / n[label > 0].sum(), counts[0] / n[label == 0].sum())
    thresholds = np.full(max(n_langs, 1), best_threshold(z, label, weight))
    for k in range(n_langs):
        mine = lang == k
        if min(n[mine & (label == v)].sum() for v in (0, 1)) >= OWN:
            thresholds[k] = best_threshold(z[mine], label[mine], weight[mine])
    return thresholds


def learn(docs: DataFrame, labels: DataFrame) -> dict:
    """Networks, languages and thresholds from all labelled documents; without both labels, the share of label 1 alone."""
    with brief_shuffles(docs.sparkSession):
        return _learned(docs, labels)


def _learned(docs: DataFrame, labels: DataFrame) -> dict:
    rows, counts = learning_rows(docs, labels)
    n = {(r.label, r.apart): r["count"] for r in rows.groupBy("label", "apart").count().collect()}
    model = {"prior": float(counts[1] / counts.sum()) if counts.sum() else 0.0}
    if all(n.get((v, a)) for v in (0, 1) for a in (False, True)):
        number, names, likely = vocabulary(rows)
        nets = trained(rows.where("not apart"), number, np.array([n[v, False] for v in (0, 1)], float))
        model |= {"number": number, "nets": nets, "likely": likely, "names": names}
        with lent(docs.sparkSession, model) as there:
            found = rows.where("apart").select("label", "words").mapInArrow(_answered(there), "lang int, label int, bin int, n long")
            found = found.groupBy("lang", "label", "bin").agg(F.sum("n").alias("n")).orderBy("lang", "label", "bin").collect()  # bins, not documents
        model["thresholds"] = level_thresholds(found, counts, len(names))
    discard(rows)
    return model


def with_tables(model: dict) -> dict:
    return {**model, "tables": [net.tables() for net in model["nets"]]} if "nets" in model and "tables" not in model else model


def _scored(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = with_tables(model)
        for batch in batches:
            for part in row_pieces(batch, "text", PIECE):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_chances(ready, part.column(part.schema.get_field_index("text"))))], ["doc_id", "score"])

    return run


def _answers(model: dict, n: int, parts: Iterator[tuple[np.ndarray, np.ndarray, int, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """The networks' mean answer to each of ``n`` texts, and their likely languages."""
    nets, likely = model["nets"], model["likely"]
    best, votes = [np.zeros((n, len(net.out)), np.float32) for net in nets], np.zeros((n, likely.shape[1]))
    for words, rows, again, last in parts:
        ids = model["number"][words]
        if last or len(ids) >= max(WIDTHS):  # windows over a part's end come with the next part
            windows = padded(ids, rows) if last else (ids, rows)
            best = [np.maximum(b, net.pooled(*windows, t)) for b, net, t in zip(best, nets, model["tables"], strict=True)]
        if likely.shape[1]:
            sums = np.zeros((len(ids) + 1, likely.shape[1]))
            np.cumsum(likely[ids], axis=0, out=sums[1:])
            votes += sums[rows[1:]] - sums[np.minimum(rows[:-1] + again, rows[1:])]
    return mean_answers(nets, best), votes.argmax(axis=1) if likely.shape[1] else np.zeros(n, np.int64)


def _chances(model: dict, texts: pa.Array) -> np.ndarray:
    if "nets" not in model:
        return np.full(len(texts), model["prior"])
    z, lang = _answers(with_tables(model), len(texts), text_parts(texts))
    return 1 / (1 + np.exp(-np.clip(z - model["thresholds"][lang], -30, 30)))


def toxicity(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text).

    A null or empty text has no words and gets the score of filters that saw only zeros. A row without doc_id is scored
    and not held out; rows that repeat a doc_id are scored one by one, and several labels of one doc_id count as their
    rounded mean. Without labels of both kinds every score is the share of label 1 (0 if there is no label). An empty
    table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_scored(model), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the toxicity of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxicity(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
