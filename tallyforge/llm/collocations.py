"""Collocations by count streams in prefix and suffix order.

Counting: a phrase that occurs often has only parts that do. A first pass adds up hashed counters of words and pairs, a
second one of runs of three and four whose pairs may be frequent; a third pass counts, as exact strings, the runs all of
whose counters may be. Counters only ever count too much, so they save work and decide nothing. What is shuffled for them
are sorted slots, coded by their gaps; the table of bits that says which counters are full grows with the text up to
``MOST_COUNTERS``. Exact counts of a task are combined and leave as blocks, which are merged on the other side.

Streams: the frequent phrases of all lengths are laid out in prefix order (by their words) and in suffix order (by their
words from the last). In prefix order every phrase follows its own beginnings, so one pass with a stack as deep as a
phrase walks the streams of all lengths in lockstep: the stack holds the counts of all beginnings, and each phrase tells
its parent how often it is extended by it. In suffix order the same pass gives the counts of endings and extensions to the
left. Both results, sorted by phrase, are joined by a merge; no hash table holds counts. Streams are cut into ranges, a
range gets the counts of the beginnings of its first phrase, three at most.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .resample import LOWER
from .shared import discard, hash_spans, materialize, mix, row_pieces, text_bytes, words_of

LEAST = 30
LONGEST = 4
TOP = 2000
#: A phrase goes if a longer one keeps this share (per cent) of its occurrences.
KEPT = 80
SCALE = 2_000_000
#: A counter for each so many bytes of text, and how many there are at least and at most: their bits go to every task, 128
#: MB at most. Beyond some hundred GB of text they rule out less and less, and more exact counts are shuffled.
COUNTER_BYTES, LEAST_COUNTERS, MOST_COUNTERS = 8, 1 << 16, 1 << 30
#: Parts that counters are added up in.
SHARDS = 64
#: Exact counts are merged in a part for each so many bytes of text, within these bounds.
PART_BYTES, LEAST_PARTS, MOST_PARTS = 8 << 20, 32, 8192
#: Bytes of text taken together, and bytes looked at behind a cut for the last words of phrases.
PIECE = 1 << 20
BEHIND = 1 << 12
#: Different counts that a task holds before it combines them, and at which it passes them on.
COMBINE, PASS_ON = 150_000, 600_000

#: Bytes that end pieces, and those that end words.
ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BREAKS = ENDS.copy()
BREAKS[[0x20, 0x09]] = True


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(langs, lower-case bytes, word starts, ends, row, piece of each word, words that begin here) of slices of rows.

    A long row comes in parts cut between words; the words behind a part, up to LONGEST - 1, come with it.
    """
    for batch in batches:
        for part in row_pieces(batch, "text", PIECE):
            langs = part.column(part.schema.get_field_index("lang")).to_pylist()
            body, offsets = text_bytes(part.column(part.schema.get_field_index("text")))
            alone = len(langs) == 1
            lo, end = int(offsets[0]), int(offsets[-1])
            while lo < end:
                hi = _cut(body, lo + PIECE, end) if alone else end
                behind = hi
                if hi < end:
                    more = BEHIND
                    while True:
                        behind = _cut(body, hi + more, end)
                        if behind == end or len(words_of(body, np.array([hi, behind]), BREAKS)[0]) >= LONGEST - 1:
                            break
                        more *= 4
                low = LOWER[body[lo:behind]]
                at = (offsets if not alone else np.array([lo, behind])) - lo
                starts, ends, rows = words_of(low, at, BREAKS)
                row = np.repeat(np.arange(len(at) - 1), np.diff(rows))
                closed = np.cumsum(ENDS[low])  # a row's end closes its piece too
                piece = closed[starts] + row
                yield langs, low, starts, ends, row, piece, int(np.searchsorted(starts, hi - lo))
                lo = hi


def _cut(body: np.ndarray, at: int, end: int) -> int:
    """The first place from ``at`` on that lies between words."""
    while at < end:
        gap = np.flatnonzero(BREAKS[body[at : min(at + PIECE, end)]])
        if len(gap):
            return at + int(gap[0])
        at += PIECE
    return end


class Counters:
    """Which counters of runs of 1 to LONGEST words are full; None where they are not counted yet."""

    def __init__(self, size: int) -> None:
        self.size, self.full = size, [None] * LONGEST

    def _hashes(self, langs: list[str], low: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> np.ndarray:
        salt = np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in langs], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return hash_spans(low, starts, ends) ^ salt[row]

    def runs(self, langs: list[str], low: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, piece: np.ndarray, most: int = LONGEST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 1 to ``most`` words: where runs begin that stand in one piece and may be frequent as far as is known, and
        their slots."""
        h = self._hashes(langs, low, starts, ends, row)
        at, key = np.arange(len(h)), h
        before = np.ones(len(h), bool)
        for k in range(1, most + 1):
            if k > 1:
                at = at[at < len(h) - k + 1]
                at = at[before[at] & before[at + 1] & (piece[at] == piece[at + k - 1])]
                key = h[at]
                for j in range(1, k):
                    key = mix(key * np.uint64(0xD1342543DE82EF95) + h[at + j])
            slots = (key % np.uint64(self.size)).astype(np.int64)
            full = self.full[k - 1]
            if full is not None:
                may = (full[slots >> 3] >> (7 - (slots & 7)) & 1).astype(bool)
                at, slots = at[may], slots[may]
            before = np.zeros(len(h) + 1, bool)
            before[at] = True
            yield at, slots


def _slotted(counters: Counters, lengths: tuple[int, ...]):
    """The slots of runs of the given lengths, each with how often it was met, in SHARDS parts a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = counters.size // SHARDS
        for *words, own in _words(batches):
            found = [slots[at < own] for k, (at, slots) in enumerate(counters.runs(*words, most=max(lengths)), 1) if k in lengths]
            slots, n = np.unique(np.concatenate(found), return_counts=True)
            cuts = np.searchsorted(slots, width * np.arange(SHARDS + 1))
            shards = np.flatnonzero(np.diff(cuts))
            packed = []
            for shard in shards:
                mine = slots[cuts[shard] : cuts[shard + 1]] - shard * width
                gaps = np.diff(mine, prepend=0).astype(np.uint32)  # by bytes of equal weight, of which the high ones are zeros
                packed.append(gaps.view(np.uint8).reshape(-1, 4).T.tobytes() + np.minimum(n[cuts[shard] : cuts[shard + 1]], 255).astype(np.uint8).tobytes())
            if packed:
                yield pa.RecordBatch.from_arrays([pa.array(shards.astype(np.int32)), pa.array(packed, pa.binary())], ["shard", "slots"])

    return run


def _filled(width: int, least: int):
    """For each shard, a bit for every counter that reached ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for shard, packed in zip(*batch.columns, strict=True):
                raw = np.frombuffer(packed.as_buffer(), np.uint8)
                n = len(raw) // 5
                at = np.cumsum(np.ascontiguousarray(raw[: 4 * n].reshape(4, n).T).view(np.uint32).ravel(), dtype=np.int64)
                seen = total.setdefault(shard.as_py(), np.zeros(width, np.uint8))
                seen[at] = np.minimum(seen[at].astype(np.uint16) + raw[4 * n :], least)
        for shard, seen in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([np.packbits(seen >= least).tobytes()], pa.binary())], ["shard", "bits"])

    return run


def _full_counters(rows: DataFrame, counters: Counters, lengths: tuple[int, ...], least: int) -> np.ndarray:
    """A bit for every counter: do the runs of the given lengths fill it?"""
    width = counters.size // SHARDS
    out = np.zeros(counters.size // 8, np.uint8)
    parts = rows.mapInArrow(_slotted(counters, lengths), "shard int, slots binary").repartition(SHARDS, "shard").mapInArrow(_filled(width, min(least, 255)), "shard int, bits binary")
    for r in parts.collect():  # SHARDS rows, a bit a counter
        out[r.shard * width // 8 : (r.shard + 1) * width // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def _texts(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as strings; spans may overlap."""
    size = ends - starts
    offsets = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=offsets[1:])
    at = np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body[at]))])


_COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("f", pa.int64())])


def _combined(held: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(held).group_by(["lang", "phrase", "words"]).aggregate([("f", "sum")])
    held.clear()
    pa.default_memory_pool().release_unused()
    return out.rename_columns({"f_sum": "f"}).select(_COUNTS.names).cast(_COUNTS)


def _blocks(counts: pa.Table, parts: int) -> Iterator[pa.RecordBatch]:
    """Combined counts as one block for each part, by a hash of the phrase."""
    body, offsets = text_bytes(counts["phrase"])
    part = (hash_spans(body, offsets[:-1], offsets[1:]) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    counts, cuts = counts.take(pa.array(order)), np.searchsorted(part[order], np.arange(parts + 1))
    held = np.flatnonzero(np.diff(cuts))
    blocks = []
    for k in held:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, _COUNTS, options=pa.ipc.IpcWriteOptions(compression="lz4")) as stream:
            stream.write_table(counts.slice(cuts[k], cuts[k + 1] - cuts[k]).combine_chunks())
        blocks.append(out.getvalue().to_pybytes())
    yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(blocks, pa.binary())], ["part", "block"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of blocks, combined as far as memory is bounded."""
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        for block in batch.column(1):
            held.append(pa.ipc.open_stream(block.as_buffer()).read_all())
            rows += held[-1].num_rows
            if rows >= COMBINE:
                held = [_combined(held)]
                rows = 0
                if held[0].num_rows >= PASS_ON:
                    yield from held.pop().to_batches(max_chunksize=10_000)
    if held:
        yield from _combined(held).to_batches(max_chunksize=10_000)


def _counted(counters: Counters, parts: int):
    """Counts of the runs that may be frequent, in blocks; the number of all words of a language comes as a run of no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for langs, low, starts, ends, row, piece, own in _words(batches):
            size = ends - starts
            at = np.cumsum(size + 1) - size - 1
            body = np.full(int((size + 1).sum()), 32, np.uint8)
            solid = np.ones(len(body), bool)
            solid[at + size] = False
            body[solid] = low[~BREAKS[low]]
            names = sorted(set(langs))
            lang = np.array([names.index(x) for x in langs], np.int64)[row]
            for name, n in zip(names, np.bincount(lang[:own], minlength=len(names)).tolist(), strict=True):
                held.append(pa.table([[name], [""], [0], [n]], schema=_COUNTS))
            for k, (first, _) in enumerate(counters.runs(langs, low, starts, ends, row, piece), 1):
                first = first[first < own]
                for which, name in enumerate(names):
                    mine = first[lang[first] == which]
                    if len(mine):
                        found = _texts(body, at[mine], at[mine + k - 1] + size[mine + k - 1]).value_counts()
                        many = len(found)
                        held.append(pa.table([pa.repeat(pa.scalar(name), many), found.field("values"), pa.repeat(pa.scalar(k, pa.int32()), many), found.field("counts")], schema=_COUNTS))
                        rows += many
            if rows >= COMBINE:
                held = [_combined(held)]
                rows = 0
                if held[0].num_rows >= PASS_ON:
                    yield from _blocks(held.pop(), parts)
        if held:
            yield from _blocks(_combined(held), parts)

    return run


def phrase_counts(docs: DataFrame, least: int = LEAST, most_counters: int = MOST_COUNTERS) -> DataFrame:
    """(lang, phrase, words, f), written: runs of 1 to LONGEST words with f of ``least`` or more, and each language's
    number of words as the empty phrase."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    counters = Counters(min(max(1 << (size // COUNTER_BYTES).bit_length(), LEAST_COUNTERS), most_counters))
    for lengths in ((1, 2), (3, 4)):
        full = _full_counters(rows, counters, lengths, least)
        for k in lengths:
            counters.full[k - 1] = full
    parts = min(max(size // PART_BYTES, LEAST_PARTS), MOST_PARTS)
    blocks = rows.mapInArrow(_counted(counters, parts), "part int, block binary").repartition(parts, "part")
    runs = blocks.mapInArrow(_merged, "lang string, phrase string, words int, f long")
    counts = runs.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("words") == 0))
    return materialize(counts, "phrases")


# --------------------------------------------------------------------------- streams in order


def _lockstep(known: dict[int, list[tuple[str, list[str], int]]]):
    """For rows (part, lang, words, f) in order: each phrase with the counts of its beginnings and its largest extension.

    ``known`` has, for a part, the beginnings of its first phrase, which stand in parts before it. What this part finds
    for those comes without f.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[list] = []  # lang, words, f, largest extension, is it of this part
        out: list[tuple] = []
        here = None

        def pop() -> None:
            lang, words, f, longest, own = stack.pop()
            if len(words) > 1 and (own or longest):
                out.append((lang, words, f if own else None, [x[2] for x in stack] if own else None, longest))

        for batch in batches:
            for part, lang, words, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != here:
                    while stack:
                        pop()
                    here = part
                    stack = [[*x, 0, False] for x in known.get(part, [])]
                while stack and (stack[-1][0] != lang or stack[-1][1] != words[: len(stack[-1][1])]):
                    pop()
                if stack and stack[-1][3] < f:
                    stack[-1][3] = f
                stack.append([lang, words, f, 0, True])
            if out:
                yield _stream_rows(out)
                out = []
        while stack:
            pop()
        if out:
            yield _stream_rows(out)

    return run


def _stream_rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.int64()), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["lang", "words", "f", "parts", "longest"])


def stream(phrases: DataFrame) -> DataFrame:
    """(lang, words, f, parts, longest), written: ``phrases`` (lang, words, f) of two words and more with the counts of
    their beginnings from one word on, and the largest count of a phrase that is longer by a last word (0 if none)."""
    laid = phrases.repartitionByRange("lang", "words").select(F.spark_partition_id().alias("part"), "lang", "words", "f")
    laid = materialize(laid, "stream")
    heads = laid.groupBy("part").agg(F.min(F.struct("lang", "words")).alias("head"))
    begins = heads.select("part", "head.lang", F.explode(F.transform(F.sequence(F.lit(1), F.size("head.words")), lambda i: F.slice("head.words", 1, i))).alias("words"))
    begins = begins.join(heads.select("part", F.col("head.words").alias("first")), "part").where(F.size("words") < F.size("first")).drop("first")
    # a row for each beginning of each part's first phrase: LONGEST - 1 a part
    known: dict[int, list] = {}
    for r in laid.drop("part").join(F.broadcast(begins), ["lang", "words"]).collect():
        known.setdefault(r.part, []).append((r.lang, r.words, r.f))
    for found in known.values():
        found.sort(key=lambda x: len(x[1]))
    parts = 1 + (laid.agg(F.max("part")).first()[0] or 0)
    ordered = laid.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "lang", "words").select("part", "lang", "words", "f")
    seen = materialize(ordered.mapInArrow(_lockstep(known), "lang string, words array<string>, f long, parts array<long>, longest long"), "stream-counts")
    late = seen.where("f is null").groupBy("lang", "words").agg(F.max("longest").alias("late"))  # of beginnings of first phrases
    out = materialize(seen.where("f is not null").join(F.broadcast(late), ["lang", "words"], "left").select("lang", "words", "f", "parts", F.greatest("longest", "late").alias("longest")), "stream-out")
    discard(laid)
    discard(seen)
    return out


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, kept: int = KEPT, most_counters: int = MOST_COUNTERS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: the first ``top`` phrases of each language of ``docs`` (lang, text).

    Score, cut and order are those of the lowest-scoring cut; a phrase goes if a longer candidate keeps ``kept`` per cent
    of it. Longer by one word is enough to look at: what holds a phrase and more words occurs no oftener than its part
    that is longer by one. A null text has no words, a null language is ``und``, a language without candidates has no
    rows. Repeated rows count each; doc_id and other columns are not read. An empty table gives an empty result. Products
    are decimals, so no count overflows.
    """
    counts = phrase_counts(docs, least, most_counters)
    words = counts.where("words > 0").select("lang", F.split("phrase", " ").alias("words"), "f")
    ahead = stream(words)
    back = stream(words.withColumn("words", F.reverse("words")))
    back = back.select("lang", F.reverse("words").alias("words"), F.reverse("parts").alias("ends"), F.col("longest").alias("longest_back"))
    both = ahead.hint("merge").join(back, ["lang", "words"]).select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), "parts", "ends", F.greatest("longest", "longest_back").alias("longest"))
    both = both.where(F.col("longest").cast("decimal(19,0)") * 100 < F.col("a").cast("decimal(19,0)") * kept)
    best = F.expr(f"array_min(transform(arrays_zip(parts, ends), (x, k) -> struct(cast({SCALE} as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(x.parts as decimal(19,0)) + x.ends) as score, k, x.parts as l, x.ends as r)))")
    scored = both.withColumn("best", best).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    first = scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return first.join(totals.hint("merge"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: collocations of all documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
),
worded AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
run AS (SELECT lang, k, unnest(list_transform(range(len(w) - k + 1), lambda i: array_to_string(w[i + 1 : i + k], ' '))) AS phrase FROM worded, (SELECT unnest([1, 2, 3, 4]) AS k)),
often AS (SELECT lang, k, phrase, count(*) AS f FROM run GROUP BY ALL HAVING count(*) >= 30),
candidate AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM often WHERE k > 1),
cut AS (SELECT *, unnest(range(1, k)) AS c FROM candidate),
scored AS (
  SELECT cut.lang, cut.phrase, cut.k, c, a, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f + y.f))::BIGINT AS score
  FROM cut JOIN often x ON x.lang = cut.lang AND x.phrase = array_to_string(cut.w[:c], ' ') JOIN often y ON y.lang = cut.lang AND y.phrase = array_to_string(cut.w[c + 1 :], ' ')
),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
kept AS (
  SELECT * FROM lowest s WHERE NOT EXISTS (
    SELECT 1 FROM candidate o WHERE o.lang = s.lang AND o.k > s.k AND 100 * o.a >= 80 * s.a AND contains(' ' || o.phrase || ' ', ' ' || s.phrase || ' '))
),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM placed JOIN total USING (lang) WHERE rank <= 2000
"""
