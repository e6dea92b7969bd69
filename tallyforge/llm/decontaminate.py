"""Benchmark decontamination: CGK embedding, bit-sampling LSH and exact edit verification.

A document leaks an item of n words if one of its n-word windows is within ``tolerance * n`` word edits of the item.
The CGK random walk copies a word sequence into a longer one, word by word, and a shared random bit for each step and
word decides whether to move on; it turns few edits into few differing positions. Each repetition walks windows and
items with its own bits and samples positions of the walks; equal samples make a candidate, and repetitions are added
until the target recall is reached; long items, whose walks agree more seldom, get more of them or fewer positions. Candidates are verified with the exact edit distance.

Before the walk, windows that cannot be within the distance are set aside by an exact bound: an edit destroys at most
two word pairs, so a window within d edits keeps all but 2 d of an item's n - 1 word pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import gram_hashes, hash_spans, materialize, mix, row_pieces, text_bytes, words_of

TOLERANCE = 0.2
RECALL = 0.999
SAMPLED = 3
#: Chance that the samples of one repetition agree at the tolerated distance; walks of 15 to 59 words with the most
#: edits allowed, substituted or inserted and deleted, agree in 0.12 (59 words) to 0.4 (15 words) of the repetitions. It
#: gives the least number of repetitions; plan() raises it by item length.
AGREE = 0.12
#: Repetitions above which an item samples fewer positions instead, so that samples agree more often.
MOST_REPS = 200
#: Pairs and walks of each that a simulation takes.
PAIRS, WALKS = 200, 64
#: Steps of a walk for each word; a walk takes about two to reach the last word.
STRETCH = 2
#: Items that one pass over the documents looks for; their hashes are broadcast.
ITEMS = 5_000
#: Windows that are walked and verified together, and the bytes of their words.
LOOKED_AT = 8192
LOOKED_BYTES = 32 << 20
#: Words that are letters and digits; all else separates. Bytes from 0x80 on belong to words.
BREAKS = np.array([not (48 <= b <= 57 or 97 <= b <= 122 or b >= 128) for b in range(256)])


def looked_at(n: int) -> int:
    """How many windows of n words are taken together."""
    return max(1, min(LOOKED_AT, LOOKED_BYTES // (8 * n)))


def edits_allowed(n: int, tolerance: float = TOLERANCE) -> int:
    return int(tolerance * n + 1e-9)


def repetitions(recall: float = RECALL, agree: float = AGREE) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - agree))


def edited(words: np.ndarray, edits: int, kind: str, rng: np.random.Generator) -> np.ndarray:
    """Rows of words with ``edits`` word edits each: substitutions, or as many deletions as insertions (n words stay)."""
    m, n = words.shape
    out = words.copy()
    for row in out:
        if kind == "substitute":
            row[rng.choice(n, edits, replace=False)] = rng.integers(1, 1 << 63, edits, dtype=np.uint64)
        elif edits > 1:
            left = np.delete(row, rng.choice(n, edits // 2, replace=False))
            row[:] = np.insert(left, rng.integers(0, len(left) + 1, edits // 2), rng.integers(1, 1 << 63, edits // 2, dtype=np.uint64))
    return out


def walks_agree(a: np.ndarray, b: np.ndarray, walks: int) -> np.ndarray:
    """Pairs x walks: the share of a walk's steps at which the two rows show the same word."""
    m, n = a.shape
    salts = mix(np.arange(1, STRETCH * n * walks + 1, dtype=np.uint64) ^ np.uint64(0x5851F42D4C957F2D)).reshape(STRETCH * n, walks, 1) | np.uint64(1)
    padded = [np.concatenate([x, np.zeros((m, 1), np.uint64)], axis=1).ravel() for x in (a, b)]
    base, at, same = np.arange(m) * (n + 1), [np.zeros((walks, m), np.int64) for _ in "ab"], np.zeros((walks, m), np.int64)
    for salt in salts:
        now = [p[base + x] for p, x in zip(padded, at, strict=True)]
        same += now[0] == now[1]
        at = [np.minimum(x + (w * salt >> np.uint64(63)).astype(np.int64), n) for x, w in zip(at, now, strict=True)]
    return same.T / (STRETCH * n)


@lru_cache(maxsize=4096)
def plan(n: int, tolerance: float = TOLERANCE, recall: float = RECALL) -> tuple[int, int]:
    """(repetitions, sampled positions) that reach the recall for items of n words with the most edits allowed.

    Pairs differ in how often their walks agree, so the chance of a miss is averaged over simulated pairs and not taken
    from the average agreement.
    """
    rng, shares = np.random.default_rng(n), []
    words = rng.integers(1, 1 << 63, (PAIRS, n), dtype=np.uint64)
    for kind in ("substitute", "shift"):
        shares.append(walks_agree(words, edited(words, edits_allowed(n, tolerance), kind, rng), WALKS))
    for sampled in range(SAMPLED, 0, -1):
        agree = [(x**sampled).mean(axis=1) for x in shares]
        missed = lambda reps, agree=agree: max(((1 - x) ** reps).mean() for x in agree)
        reps = repetitions(recall)
        while missed(reps) > 1 - recall and (sampled == 1 or reps <= MOST_REPS) and reps < n * 100:
            reps = math.ceil(reps * 1.1)
        if sampled == 1 or reps <= MOST_REPS:
            return reps, sampled
    raise AssertionError


def walk_keys(sequences: np.ndarray, reps: int, sampled: int = SAMPLED) -> np.ndarray:
    """Keys, repetitions x rows: each row's (equally many word hashes) CGK walk at ``sampled`` random positions."""
    m, n = sequences.shape
    steps = STRETCH * n
    taken = np.zeros((steps, reps), bool)
    for r in range(reps):
        taken[np.random.default_rng([r, n]).choice(steps, min(sampled, steps), replace=False), r] = True
    salts = mix(np.arange(1, steps * reps + 1, dtype=np.uint64)).reshape(steps, reps, 1) | np.uint64(1)
    padded = np.concatenate([sequences, np.zeros((m, 1), np.uint64)], axis=1).ravel()
    base = np.arange(m) * (n + 1)
    at = np.zeros((reps, m), np.int64)
    key = np.zeros((reps, m), np.uint64)
    for step in range(int(np.flatnonzero(taken.any(axis=1))[-1]) + 1 if m else 0):
        now = padded[base + at]
        if (use := taken[step]).any():
            key[use] = mix(key[use] ^ now[use]) + np.uint64(step + 1)
        at = np.minimum(at + (now * salts[step] >> np.uint64(63)).astype(np.int64), n)
    return key


def edit_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Levenshtein distance of each pair of rows (m x n and m x n)."""
    m, n = a.shape
    _, small = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = small.reshape(2, m, n).astype(np.int32)
    steps = np.arange(n + 1, dtype=np.int32 if n > 10_000 else np.int16)
    row = np.broadcast_to(steps, (m, n + 1)).copy()
    for i in range(n):
        change = row[:, :-1] + (a[:, i : i + 1] != b)
        below = row + 1
        below[:, 1:] = np.minimum(below[:, 1:], change)
        row = np.minimum.accumulate(below - steps, axis=1) + steps
    return row[:, -1]


def _distinct(kinds: np.ndarray) -> np.ndarray:
    """How many different values other than -1 each row has."""
    kinds = np.sort(kinds, axis=1)
    return (np.diff(kinds, axis=1, prepend=-1) != 0).sum(axis=1)


class Items:
    """Items as word hashes by length, with the keys of their walks."""

    def __init__(self, ids: list[int], texts: list[str], tolerance: float, recall: float) -> None:
        self.tolerance = tolerance
        column = pa.array(texts, pa.string())
        body, offsets = text_bytes(column)
        starts, ends, rows = words_of(body, offsets, BREAKS)
        words = hash_spans(body, starts, ends)
        by: dict[int, list[int]] = {}
        for i in range(len(ids)):
            if n := int(rows[i + 1] - rows[i]):
                by.setdefault(n, []).append(i)
        self.ids = {n: np.array([ids[i] for i in at]) for n, at in by.items()}
        self.words = {n: np.stack([words[rows[i] : rows[i + 1]] for i in at]) for n, at in by.items()}
        pairs = {n: np.unique(gram_hashes(x.ravel(), 2)[np.arange(x.size - 1) % n != n - 1]) for n, x in self.words.items()}
        self.pairs = np.unique(np.concatenate(list(pairs.values()))) if pairs else np.zeros(0, np.uint64)
        self.pair_of = {n: np.isin(self.pairs, x) for n, x in pairs.items()}
        #: Word pairs that an item of n words has more than once, at most.
        self.doubled = {n: max(n - 1 - len(np.unique(gram_hashes(w, 2))) for w in x) for n, x in self.words.items()}
        self.singles = self.words[1].ravel() if 1 in self.words else np.zeros(0, np.uint64)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.pairs & np.uint64((1 << 20) - 1)] = True
        self.plan = {n: plan(n, tolerance, recall) for n in self.words}
        self.keys: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for n, x in self.words.items():
            for r, key in enumerate(walk_keys(x, *self.plan[n])):
                order = np.argsort(key, kind="stable")
                self.keys[n, r] = key[order], order

    def known_pairs(self, words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where word pairs of items begin, and which pairs they are; no pair crosses a row."""
        pairs = gram_hashes(words, 2)
        if not len(pairs) or not len(self.pairs):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        crosses = rows[1:-1] - 1
        at = self.seen[pairs & np.uint64((1 << 20) - 1)]
        at[crosses[(crosses >= 0) & (crosses < len(at))]] = False
        at = np.flatnonzero(at)
        which = np.minimum(np.searchsorted(self.pairs, pairs[at]), len(self.pairs) - 1)
        same = self.pairs[which] == pairs[at]
        return at[same], which[same]

    def windows_in_reach(self, n: int, words: np.ndarray, rows: np.ndarray, at: np.ndarray, which: np.ndarray) -> np.ndarray:
        """First words of the n-word windows that keep enough word pairs of items of n words."""
        least = n - 1 - 2 * edits_allowed(n, self.tolerance)
        if n == 1:
            starts = np.flatnonzero(np.isin(words, self.singles))
        elif least <= 0:
            starts = np.arange(max(0, len(words) - n + 1))
        else:
            mine = self.pair_of[n][which]
            at, kinds = at[mine], which[mine]
            if len(at) < least:
                return at[:0]
            low, high = at[least - 1 :] - (n - 2), at[: len(at) - least + 1]
            near = high >= low
            low, many = low[near], (high - low + 1)[near]
            starts = np.unique(np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum())))
            starts = starts[(starts >= 0) & (starts + n <= len(words))]
            known = np.full(len(words), -1, np.int64)
            known[at] = kinds
            step = looked_at(n)
            held = np.concatenate([_distinct(known[starts[i : i + step, None] + np.arange(n - 1)]) for i in range(0, len(starts) or 1, step)])
            starts = starts[held >= least - self.doubled[n]]
        ends = rows[1:][np.searchsorted(rows[1:], starts, side="right")] if len(starts) else starts
        return starts[starts + n <= ends]

    def candidates(self, n: int, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs that meet in one of the repetitions."""
        found = []
        for r, mine in enumerate(walk_keys(windows, *self.plan[n])):
            keys, items = self.keys[n, r]
            lo, hi = np.searchsorted(keys, mine, side="left"), np.searchsorted(keys, mine, side="right")
            hit = np.flatnonzero(hi > lo)
            many = (hi - lo)[hit]
            window = np.repeat(hit, many)
            at = np.repeat(lo[hit] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            found.append(window * len(items) + items[at])
        both = np.unique(np.concatenate(found))
        return both // len(items), both % len(items)

    def windows(self, words: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each item length n, the windows within reach: their rows, first words in the row, and words (m x n)."""
        pairs_at, which = self.known_pairs(words, rows)
        for n in sorted(self.words):
            starts = self.windows_in_reach(n, words, rows, pairs_at, which)
            step = looked_at(n)
            for i in range(0, len(starts), step):
                part = starts[i : i + step]
                row = np.searchsorted(rows, part, side="right") - 1
                yield n, row, part - rows[row], words[part[:, None] + np.arange(n)]

    def verified(self, n: int, windows: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(window, item id, distance) of the candidates within the allowed distance."""
        step = max(1, looked_at(n) * repetitions() // self.plan[n][0])  # walks of many repetitions take fewer windows at once
        parts = [self.candidates(n, windows[i : i + step]) for i in range(0, len(windows), step)]
        window = np.concatenate([w + i * step for i, (w, _) in enumerate(parts)])
        item = np.concatenate([x for _, x in parts])
        if len(window):
            many = looked_at(n)
            distance = np.concatenate([edit_distances(windows[window[i : i + many]], self.words[n][item[i : i + many]]) for i in range(0, len(window), many)])
            near = distance <= edits_allowed(n, self.tolerance)
            yield from zip(window[near].tolist(), self.ids[n][item[near]].tolist(), distance[near].tolist(), strict=True)


class Search:
    """Windows wait by length until enough of them make one array step worth while."""

    def __init__(self, items: Items) -> None:
        self.items, self.best = items, {}
        self.wait: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

    def add(self, docs: np.ndarray, words: np.ndarray, rows: np.ndarray) -> None:
        for n, row, at, windows in self.items.windows(words, rows):
            held = self.wait.setdefault(n, [])
            held.append((docs[row], at, windows))
            if sum(len(x[1]) for x in held) >= looked_at(n):
                self.look(n)

    def look(self, n: int) -> None:
        docs, at, windows = (np.concatenate(x) for x in zip(*self.wait.pop(n), strict=True))
        for w, item, distance in self.items.verified(n, windows):
            key, value = (int(docs[w]), item), (distance, int(at[w]), n)
            self.best[key] = min(self.best.get(key, value), value)

    def found(self) -> list[tuple[int, int, int, int, int]]:
        """(doc_id, item id, first word, words, distance): each document's closest window to each item, so far."""
        for n in list(self.wait):
            self.look(n)
        out = [(doc, item, at, n, d) for (doc, item), (d, at, n) in sorted(self.best.items())]
        self.best = {}
        return out


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(shared.value)
        for batch in batches:
            for piece in row_pieces(batch, "text"):
                body, offsets = text_bytes(piece.column(1))
                starts, ends, rows = words_of(body, offsets, BREAKS)
                search.add(piece.column(0).to_numpy(), hash_spans(body, starts, ends), rows)
            doc, item, at, n, d = zip(*found, strict=True) if (found := search.found()) else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(item, pa.int64()), pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(d, pa.int32())], ["doc_id", "item_id", "start", "words", "distance"])

    return run


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", tolerance: float = TOLERANCE, recall: float = RECALL) -> DataFrame:
    """doc_id, item_id, start (first word), words and distance: each document's closest window to each item it leaks.

    Words are runs of letters and digits in lower case; ties go to the earlier window. Items are broadcast in blocks of
    ``ITEMS``, each of which is searched for in all documents, so a larger benchmark means more passes and not a larger
    broadcast. Null and empty texts and items have no words and leak nothing. A document shorter than an item has no
    window of its size. Rows that repeat a doc_id are one document with the best of their windows, and so are items that
    repeat an item_id; rows without an id are left out. Empty tables give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(F.col(text_col).cast("string")).alias("text")).where("doc_id is not null and text is not null")
    wanted = items.select(F.col(item_id_col).cast("long").alias("item_id"), F.lower(F.col(item_text_col).cast("string")).alias("text")).where("item_id is not null and text is not null")
    blocks = max(1, -(-wanted.count() // ITEMS))
    at = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    out = None
    for b in range(blocks):
        held = wanted.where(at == b).collect()
        shared = spark.sparkContext.broadcast(Items([r.item_id for r in held], [r.text for r in held], tolerance, recall))
        found = rows.mapInArrow(_search(shared), "doc_id long, item_id long, start int, words int, distance int")
        if blocks > 1:  # one block's items at a time are in memory
            found = materialize(found, "leaks")
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    best = out.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "start", "words")).alias("best"))
    return best.select("doc_id", "item_id", "best.start", "best.words", "best.distance")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: all benchmark items in all documents."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
