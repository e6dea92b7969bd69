"""Substring dedup: suffix automata of reference shards, matching statistics, maximal spans removed.

Every window of ``window`` words has an anchor, the word 6-gram with the smallest hash in it. Equal windows
have equal anchors, so the corpus falls into reference shards (all text around one anchor) that can be judged
apart. Within a shard, the stretches that share one anchor occurrence ("stretches") are taken in document order:
a stretch equal to an earlier one is repeated as a whole; each other stretch streams through the suffix automaton
of the shard's earlier stretches, and runs whose matching statistic reaches ``window`` are repeated.
A shard above ``most`` different stretches is cut again by a longer anchor, up to the window itself, where each shard is
one window and a stretch can only be equal as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, gram_hashes, hash_spans, materialize, mix, range_hashes, row_pieces, text_bytes, words_of

#: Words of the first anchor, and words it grows by where a shard is cut again.
ANCHOR, GROWS = 6, 7
#: Different stretches of one shard that one automaton takes; larger shards are cut again.
MOST = 2000


# --------------------------------------------------------------------------- stretches


def _leftmost_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the position of its smallest, the leftmost of equals."""
    best, at, span = values, np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left, right = best[: len(best) - step], best[step:]
        keep = left <= right
        at = np.where(keep, at[: len(left)], at[step:])
        best = np.where(keep, left, right)
        span += step
    return at


def stretches(words: np.ndarray, rows: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(row, start in the row, windows, anchor hash, content hash) of each stretch of hashed words; anchors have ``anchor`` words."""
    sizes = np.diff(rows)
    if len(words) < window:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    grams = gram_hashes(words, anchor)
    chosen = _leftmost_minimum(grams, window - anchor + 1)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(chosen))
    at = at[at + window <= rows[1:][row[: len(chosen)]]]
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    new = np.flatnonzero(np.r_[True, (chosen[at[1:]] != chosen[at[:-1]]) | (at[1:] != at[:-1] + 1)])
    first = at[new]
    many = np.diff(np.r_[new, len(at)])
    content = range_hashes(words, first, first + many + window - 1)
    return row[first], first - rows[row[first]], many, grams[chosen[first]], content


#: ``base`` is where the row that a stretch was cut from starts in its document.
STRETCH = "anchor long, content long, doc_id long, start int, base int, windows int, known boolean"


def _stretch_batch(row: np.ndarray, doc: np.ndarray, start: np.ndarray, base: np.ndarray, many: np.ndarray, anchor: np.ndarray, content: np.ndarray, window: int) -> pa.RecordBatch:
    """Stretches of a piece of rows, combined before the shuffle.

    Of equal stretches of a piece only the first in document order is left to compare; the others are repeats wherever
    the first of all is. They leave as merged spans with ``known`` set and a key of their own, so that a stretch that
    fills the corpus is no hot key.
    """
    order = np.lexsort((start, doc, content))
    first = order[np.maximum.accumulate(np.where(np.r_[True, content[order][1:] != content[order][:-1]], np.arange(len(order)), 0))]
    later = order[(doc[order] != doc[first]) | (start[order] != start[first])]
    repeat = np.zeros(len(row), bool)
    repeat[later] = True
    at = np.flatnonzero(repeat)
    end = start[at] + many[at] + window - 1
    opens = np.flatnonzero(np.r_[True, (row[at][1:] != row[at][:-1]) | (start[at][1:] > end[:-1])]) if len(at) else at
    head, tail = at[opens], (at[np.r_[opens[1:], len(at)] - 1] if len(at) else at)
    size = start[tail] + many[tail] - start[head]
    own = mix(doc[head].astype(np.uint64) ^ mix(start[head].astype(np.uint64)))
    new = ~repeat
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.r_[anchor[new], own].view(np.int64)),
            pa.array(np.r_[content[new], own].view(np.int64)),
            pa.array(np.r_[doc[new], doc[head]]),
            pa.array(np.r_[start[new], start[head]].astype(np.int32)),
            pa.array(np.r_[base[new], base[head]].astype(np.int32)),
            pa.array(np.r_[many[new], size].astype(np.int32)),
            pa.array(np.r_[np.zeros(int(new.sum()), bool), np.ones(len(head), bool)]),
        ],
        ["anchor", "content", "doc_id", "start", "base", "windows", "known"],
    )


def _stretch_rows(window: int, width: int):
    """The stretches of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in row_pieces(batch, "text"):
                body, offsets = text_bytes(piece.column(1))
                starts, ends, rows = words_of(body, offsets)
                row, start, many, anchor, content = stretches(hash_spans(body, starts, ends), rows, window, width)
                if len(row):
                    yield _stretch_batch(row, piece.column(0).to_numpy()[row], start, np.zeros(len(row), np.int32), many, anchor, content, window)

    return run


def _narrower_rows(window: int, width: int):
    """The stretches, by longer anchors, of stretches of too large a shard; starts stay those of the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in row_pieces(batch, "words"):
                doc, base, packed = piece.column(0).to_numpy(), piece.column(1).to_numpy(), piece.column(2).to_pylist()
                rows = np.cumsum([0, *(len(p) // 8 for p in packed)])
                row, start, many, anchor, content = stretches(np.frombuffer(b"".join(packed), np.uint64), rows, window, width)
                if len(row):
                    yield _stretch_batch(row, doc[row], base[row] + start, base[row], many, anchor, content, window)

    return run


# --------------------------------------------------------------------------- automata


class SuffixAutomaton:
    """An online generalised suffix automaton over integer symbols."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _clone(self, p: int, q: int, symbol: int) -> int:
        nxt, link = self.next, self.link
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        self.length.append(self.length[p] + 1)
        link[q] = copy
        while p >= 0 and nxt[p].get(symbol) == q:
            nxt[p][symbol] = copy
            p = link[p]
        return copy

    def add(self, symbols: list[int]) -> None:
        """Take in one more string."""
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for s in symbols:
            q = nxt[last].get(s)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._clone(last, q, s)
                continue
            new = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and s not in nxt[p]:
                nxt[p][s] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][s]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, s)
            last = new

    def matching(self, symbols: list[int]) -> list[int]:
        """At each position, the length of the longest suffix so far that occurs in a string taken in."""
        nxt, link, length = self.next, self.link, self.length
        state, have, out = 0, 0, []
        for s in symbols:
            while state and s not in nxt[state]:
                state = link[state]
                have = length[state]
            if s in nxt[state]:
                state = nxt[state][s]
                have += 1
            else:
                have = 0
            out.append(have)
        return out


def _long_runs(found: list[int], window: int) -> list[tuple[int, int]]:
    """Spans of words covered by windows whose matching statistic reaches ``window``."""
    spans: list[tuple[int, int]] = []
    for end, have in enumerate(found, 1):
        if have >= window:
            if spans and spans[-1][1] >= end - window:
                spans[-1] = (spans[-1][0], end)
            else:
                spans.append((end - window, end))
    return spans


def _automaton_spans(window: int):
    """Rows come sorted by (anchor, doc_id, start); only one shard's automaton is held at a time.

    Different texts at one place wait for each other, as a place is no repeat of itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, here, waiting = SuffixAutomaton(), None, {}
        for batch in batches:
            docs, starts, ends = [], [], []
            for anchor, doc, start, packed in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if here != (anchor, doc, start):
                    if here and here[0] == anchor:
                        for symbols in waiting.values():
                            automaton.add(symbols)
                    else:
                        automaton = SuffixAutomaton()
                    here, waiting = (anchor, doc, start), {}
                if packed in waiting:
                    continue
                waiting[packed] = symbols = np.frombuffer(packed, np.int64).tolist()
                for a, b in _long_runs(automaton.matching(symbols), window):
                    docs.append(doc)
                    starts.append(start + a)
                    ends.append(start + b)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["doc_id", "start", "end"])

    return run


def _content_rows(window: int):
    """The hashed words of each wanted stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in row_pieces(batch, "text"):
                body, offsets = text_bytes(piece.column(1))
                starts, ends, rows = words_of(body, offsets)
                words = hash_spans(body, starts, ends)
                anchors, shards, docs, at, packed = [], [], [], [], []
                for i, (doc, wanted) in enumerate(zip(piece.column(0).to_pylist(), piece.column(2).to_pylist(), strict=True)):
                    for w in wanted:
                        a = int(rows[i]) + w["start"]
                        b = a + w["windows"] + window - 1
                        if b <= rows[i + 1]:
                            anchors.append(w["anchor"])
                            shards.append(w["different"])
                            docs.append(doc)
                            at.append(w["start"])
                            packed.append(words[a:b].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchors, pa.int64()), pa.array(shards, pa.int64()), pa.array(docs, pa.int64()), pa.array(at, pa.int32()), pa.array(packed, pa.binary())],
                    ["anchor", "different", "doc_id", "start", "words"],
                )

    return run


def _kept_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in row_pieces(batch, "text", 4 << 20):
            body, offsets = text_bytes(piece.column(1))
            n_words, n_removed, texts, merged = [], [], [], []
            for i, spans in enumerate(piece.column(2).to_pylist()):
                words = body[offsets[i] : offsets[i + 1]].tobytes().split()
                kept, cut, gone, last = [], [], 0, 0
                for s in sorted((x["start"], x["end"]) for x in spans or ()):
                    a, b = s[0], min(s[1], len(words))
                    if a >= b:
                        continue
                    if cut and a <= cut[-1]["end"]:
                        cut[-1]["end"] = max(cut[-1]["end"], b)
                    else:
                        cut.append({"start": a, "end": b})
                for c in cut:
                    kept += words[last : c["start"]]
                    gone += c["end"] - c["start"]
                    last = c["end"]
                kept = kept + words[last:] if cut else words
                n_words.append(len(words))
                n_removed.append(gone)
                merged.append(cut)
                texts.append(b" ".join(kept))
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(merged, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(texts, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "removed", "kept"],
            )


def _shards(found: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Spans of stretches that are equal to an earlier one, and the first of each different stretch of shards with several.

    The latter are (anchor, doc_id, start, base, windows, different); ``different`` counts the stretches of the shard.
    """
    end = (F.col("start") + F.col("windows") + F.lit(window - 1)).cast("int").alias("end")
    known = materialize(found.where("known").select("doc_id", "start", end), "known-spans")
    # counts combine before the shuffle and are written, so that hot anchors meet their rows in joins of plain tables, which Spark can split
    held = materialize(found.where("not known").groupBy("anchor").agg(F.count(F.lit(1)).alias("held")).where("held > 1").select("anchor"), "shared-anchors")
    live = materialize(found.where("not known").join(held, "anchor").drop("known"), "live-stretches")
    discard(found)
    first = F.min(F.struct("doc_id", "start", "base")).alias("first")
    contents = materialize(live.groupBy("anchor", "content").agg(first, F.max("windows").alias("windows"), F.count(F.lit(1)).alias("n")), "contents")
    repeats = live.join(contents.where("n > 1").select("anchor", "content", "first"), ["anchor", "content"]).where("doc_id != first.doc_id or start != first.start")
    shards = materialize(contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("different")).where("different > 1"), "shards")
    return known.unionByName(repeats.select("doc_id", "start", end)), contents.join(shards, "anchor").select("anchor", "first.*", "windows", "different")


def repeated_spans(docs: DataFrame, window: int = 20, most: int = MOST) -> DataFrame:
    """(doc_id, start, end) word spans covered by windows that also start earlier; spans may overlap.

    ``docs`` has doc_id and text. Earlier means a smaller doc_id, or the same document and an earlier start.
    """
    width = min(ANCHOR, window)
    found = materialize(docs.mapInArrow(_stretch_rows(window, width), STRETCH), "stretches")
    spans, different = _shards(found, window)
    wanted = different.groupBy("doc_id").agg(F.collect_list(F.struct("start", "windows", "anchor", "different")).alias("wanted"))
    content = docs.join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(_content_rows(window), "anchor long, different long, doc_id long, start int, words binary")
    while True:
        content = materialize(content, "stretch-words")
        parts = content.where(F.col("different") <= most).select("anchor", "doc_id", "start", "words").repartition("anchor").sortWithinPartitions("anchor", "doc_id", "start")
        spans = spans.unionByName(parts.mapInArrow(_automaton_spans(window), "doc_id long, start int, end int"))
        large = content.where(F.col("different") > most).select("doc_id", F.col("start").alias("base"), "words").distinct()
        if width == window or large.isEmpty():
            return spans
        large = materialize(large, "large-shards")
        width = min(width + GROWS, window)
        found = materialize(large.mapInArrow(_narrower_rows(window, width), STRETCH), "stretches")
        whole, different = _shards(found, window)
        spans = spans.unionByName(whole)
        size = 8 * (F.col("windows") + window - 1)
        content = different.join(large, ["doc_id", "base"]).withColumn("words", F.col("words").substr(8 * (F.col("start") - F.col("base")) + 1, size))
        content = content.where(F.octet_length("words") == size).select("anchor", "different", "doc_id", "start", "words")


def remove_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, most: int = MOST) -> DataFrame:
    """Each document without the words that repeat earlier text.

    Returns doc_id, n_words, n_removed, removed (merged word spans, end exclusive) and kept (the words left,
    joined by one space). Words are the longest runs without space and 0x09-0x0D bytes, unchanged.

    Null and empty texts have no words and an empty ``kept``. Documents under ``window`` words lose nothing.
    Equal stretches at different places are ties that the smaller (doc_id, start) wins. Rows that repeat a doc_id count
    as one document: a window at the same place is no repeat, and the spans found apply to every row with that doc_id. Rows without doc_id are returned whole. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spans = repeated_spans(rows.where("doc_id is not null"), window, most)
    by_doc = spans.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return rows.join(by_doc, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(_kept_texts, "doc_id long, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: 20-word windows over all documents."""
    out = remove_repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
