"""Line dedup by pairwise alignment: rare shared lines find pairs, patience diff aligns them.

What two documents have to share to overlap is an anchor: a rare line (in at most ``rare`` documents), a line of ``long``
words, two lines running of ``long`` words together, ``many`` lines running, or any line of a document of at most two
lines. Each anchor of a document leads to the nearest earlier document that has it, so an anchor of n documents gives
n - 1 pairs at most and never all pairs, and every anchor that any earlier document has is part of some pair. A pair is
aligned by a patience diff; anchors that it leaves out because they stand in another order or repeat are aligned as
blocks of their own. Aligned lines leave the later document.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import discard, materialize, row_slices

#: Most documents that have a rare line.
RARE = 50
#: Shared lines running that make an overlap however many documents have them; blank lines do not count.
MANY = 3
#: Words of one or two shared lines running that do.
LONG = 20
#: Lines of a document whose every line is an anchor.
FEW = 2
BLANK = 0
#: Lines that one step of the alignment takes as Python lists.
STEP = 1 << 18


def _rising(values: list[int]) -> list[int]:
    """Indices of a longest strictly rising subsequence (patience sorting)."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        p = bisect_left(tops, v)
        back.append(piles[p - 1] if p else -1)
        if p == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[p], piles[p] = v, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _numbered(lines: list[int]) -> list[tuple[int, int]]:
    """Each line with how many equal ones stand before it."""
    seen: Counter[int] = Counter()
    out = []
    for v in lines:
        out.append((v, seen[v]))
        seen[v] += 1
    return out


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of two line lists, ascending.

    Common lines at a range's two ends are aligned first; then lines that occur once in either range and lie on a longest
    rising run become anchors, and the gaps between anchors are treated alike. Where every common line repeats, the n-th
    of one range meets the n-th of the other. Blank lines are never anchors.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        in_a, in_b = Counter(a[i:j]), Counter(b[k:m])
        where = {v: q for q, v in enumerate(b[k:m], k) if in_b[v] == 1}
        once = [(p, where[v]) for p, v in enumerate(a[i:j], i) if v != BLANK and in_a[v] == 1 and v in where]
        if not once:
            where = {key: q for q, key in enumerate(_numbered(b[k:m]), k)}
            once = [(p, where[key]) for p, key in enumerate(_numbered(a[i:j]), i) if key[0] != BLANK and key in where]
        anchors = [once[x] for x in _rising([q for _, q in once])]
        if not anchors:
            continue
        p0, q0 = i, k
        for p, q in anchors:
            todo.append((p0, p, q0, q))
            p0, q0 = p, q
        todo.append((p0, j, q0, m))  # each range but the first opens with its anchor, which the first step aligns
    return sorted(out)


def run_key(lines: list, width: int):
    """A 64-bit key of lines running: each line's hash, rotated by its place, combined bit by bit.

    ``lines`` are Spark columns or numpy integers.
    """
    out = lines[0]
    for i, x in enumerate(lines[1:width], 1):
        turn = 64 * i // width
        if isinstance(x, Column):
            out = out.bitwiseXOR(F.shiftleft(x, turn).bitwiseOR(F.shiftrightunsigned(x, 64 - turn)))
        else:
            out = out ^ (x << np.uint64(turn) | x >> np.uint64(64 - turn))
    return out


def removed_positions(later: np.ndarray, earlier: np.ndarray, anchors: set[tuple[int, int]]) -> list[int]:
    """Positions of the later document's lines that go; ``anchors`` are the (width, key) that both documents have."""
    at = np.flatnonzero(later != BLANK)
    mine, other = later[at], earlier[earlier != BLANK]
    gone = np.zeros(len(mine), bool)
    aligned = [p for p, _ in patience(mine.tolist(), other.tolist())]
    gone[aligned] = True
    if not gone.all():
        raw = mine.view(np.uint64)
        for width in {w for w, _ in anchors}:
            keys = run_key([raw[i : len(raw) - width + 1 + i] for i in range(width)], width).view(np.int64)
            starts = np.flatnonzero(np.isin(keys, np.array([k for w, k in anchors if w == width], np.int64)))
            for i in range(width):
                gone[starts + i] = True
    return at[gone].tolist()


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = np.cumsum(sum(batch.column(i).value_lengths().to_numpy() for i in (1, 2)))
        for lo, hi in row_slices(np.r_[0, ends], STEP):
            part = batch.slice(lo, hi - lo)
            later, earlier, anchors = (part.column(i) for i in (1, 2, 3))
            positions = [
                removed_positions(later[i].values.to_numpy(), earlier[i].values.to_numpy(), {(x["width"], x["key"]) for x in anchors[i].as_py()}) for i in range(part.num_rows)
            ]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(positions, pa.list_(pa.int32()))], ["doc", "positions"])


def _flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of positions to one list of booleans by position."""
    for batch in batches:
        gone = []
        for lists in batch.column(1).to_pylist():
            top = max((p for x in lists for p in x), default=-1)
            mark = [False] * (top + 1)
            for x in lists:
                for p in x:
                    mark[p] = True
            gone.append(mark)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.list_(pa.bool_()))], ["doc", "gone"])


def _split(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _anchors(many: int, long: int) -> Column:
    """The different (width, key, words) that may be anchors of a document with the columns full (line, words) and n."""

    def running(width: int, of) -> Column:
        first = F.when(F.col("n") >= width, F.sequence(F.lit(0), F.col("n") - width)).otherwise(F.array().cast("array<int>"))
        return F.transform(first, lambda i: of([F.get("full", i + j) for j in range(width)]))

    key = lambda width, x: F.struct(F.lit(width).alias("width"), run_key([y["line"] for y in x], width).alias("key"), sum(y["words"] for y in x).alias("words"))
    one = F.transform("full", lambda x: F.struct(F.lit(1).alias("width"), x["line"].alias("key"), x["words"].alias("words")))
    two = F.array_compact(running(2, lambda x: F.when((x[0]["words"] < long) & (x[1]["words"] < long) & (x[0]["words"] + x[1]["words"] >= long), key(2, x))))
    return F.array_distinct(F.concat(one, two, running(many, lambda x: key(many, x))))


def _after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of width, key and doc, with the doc of the row before where width and key are the same."""
    part, last = TaskContext.get().partitionId(), None
    for batch in batches:
        if not batch.num_rows:
            continue
        width, key = (batch.column(i).to_numpy() for i in (0, 1))
        docs = batch.column(2)
        held = pa.concat_arrays([last[2], docs]) if last else docs
        same = np.r_[bool(last) and last[:2] == (width[0], key[0]), (width[1:] == width[:-1]) & (key[1:] == key[:-1])]
        at = np.arange(len(docs)) - (0 if last else 1)
        earlier = held.take(pa.array(at, pa.int64(), mask=~same))
        last = (width[-1], key[-1], docs.slice(len(docs) - 1))
        yield pa.RecordBatch.from_arrays([*batch.columns, earlier, pa.array(np.full(len(docs), part, np.int32))], [*batch.schema.names, "earlier", "part"])


def nearest_earlier(met: DataFrame) -> DataFrame:
    """Rows of ``met`` (width, key, doc, few, always) whose anchor an earlier document has, with the nearest such one.

    All rows are put in order over ranges, which cut a frequent anchor as often as its length asks for; the first row of
    a range finds its document in the last row of the range before, so no anchor has a first holder but one.
    """
    ordered = met.select("width", "key", "doc", "few", "always").repartitionByRange("width", "key", "doc").sortWithinPartitions("width", "key", "doc")
    doc = met.schema["doc"].dataType.simpleString()
    rows = materialize(ordered.mapInArrow(_after, f"width int, key long, doc {doc}, few boolean, always boolean, earlier {doc}, part int"), "in-order")
    row = F.struct("width", "key", "doc")
    ends = rows.groupBy("part").agg(F.min(row).alias("first"), F.max(row).alias("last"))  # a row a range
    ends = ends.withColumn("before", F.lag("last").over(Window.orderBy("part")))
    ends = ends.where((F.col("first.width") == F.col("before.width")) & (F.col("first.key") == F.col("before.key"))).select("first.*", F.col("before.doc").alias("across"))
    found = rows.join(F.broadcast(ends), ["width", "key", "doc"], "left").withColumn("earlier", F.coalesce("earlier", "across"))
    return found.where(F.col("earlier").isNotNull() & (F.col("earlier") != F.col("doc"))).drop("across", "part")


def removed_lines(rows: DataFrame, rare: int = RARE, many: int = MANY, long: int = LONG) -> DataFrame:
    """(doc, gone): for documents that lose lines, whether each line goes; ``rows`` has doc (orderable) and text."""
    words = F.transform(_split(F.col("text")), lambda x: F.regexp_count(x, F.lit(r"\S+")))
    hashed = F.transform(_split(F.col("text")), lambda x: F.when(F.trim(x) == "", F.lit(BLANK)).otherwise(F.xxhash64(x)))
    lists = materialize(rows.where("text is not null").select("doc", hashed.alias("lines"), words.alias("words")).dropDuplicates(["doc"]), "lines")
    full = lists.select("doc", F.filter(F.arrays_zip(F.col("lines").alias("line"), "words"), lambda x: x["line"] != BLANK).alias("full"))
    full = full.select("doc", "full", F.size("full").alias("n"))
    occurs = full.select("doc", (F.col("n") <= FEW).alias("few"), F.inline(_anchors(many, long)))
    shared = occurs.groupBy("width", "key").agg(F.count(F.lit(1)).alias("docs"), F.max("words").alias("most"), F.max("few").alias("some_few")).where("docs > 1")
    anchor = (F.col("width") > 1) | (F.col("docs") <= rare) | (F.col("most") >= long)
    # written, so that the join below is between two plain tables whose hot keys Spark can split
    shared = materialize(shared.where(anchor | F.col("some_few")).select("width", "key", "docs", anchor.alias("always")), "shared-lines")
    met = materialize(occurs.select("doc", "few", "width", "key").join(shared, ["width", "key"]), "holders")
    pairs = nearest_earlier(met).where(F.col("always") | F.col("few"))
    pairs = materialize(pairs.groupBy("doc", "earlier").agg(F.collect_list(F.struct("width", "key")).alias("anchors")), "line-pairs")
    sides = pairs.hint("merge").join(lists.select("doc", F.col("lines").alias("later")), "doc").hint("merge").join(lists.select(F.col("doc").alias("earlier"), F.col("lines").alias("before")), "earlier")
    doc_type = rows.schema["doc"].dataType.simpleString()
    aligned = sides.select("doc", "later", "before", "anchors").mapInArrow(_align, f"doc {doc_type}, positions array<int>").where(F.size("positions") > 0)
    gone = materialize(aligned.groupBy("doc").agg(F.collect_list("positions").alias("positions")).mapInArrow(_flags, f"doc {doc_type}, gone array<boolean>"), "gone-lines")
    for table in (lists, shared, met, pairs):
        discard(table)
    return gone


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = RARE, many: int = MANY, long: int = LONG) -> DataFrame:
    """All columns of ``docs`` with the text cut, plus n_lines and n_removed.

    A short line (under ``long`` words) that more than ``rare`` documents have is no overlap where it stands alone; it
    goes only where it is aligned beside an anchor. Lines end at a line feed. A null text stays null and has no lines; an empty text has one blank line. Blank lines are
    neither matched nor removed. The later document is the one with the larger doc_id; rows that repeat a doc_id with
    another text are documents of their own, later by a hash of the text, and rows equal in both are one document and
    fare alike. Rows without doc_id stay whole. An empty table gives an empty result. Columns named n_lines or n_removed
    are replaced; no other column is read or changed.
    """
    text = F.col(text_col).cast("string")
    rows = docs.drop("n_lines", "n_removed")
    key = F.struct(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("tag"))
    plain = rows.where(F.col(id_col).isNotNull()).select(key.alias("doc"), text.alias("text"))
    gone = removed_lines(plain, rare, many, long).select(F.col("doc.doc_id").alias("__id"), F.col("doc.tag").alias("__tag"), F.col("gone").alias("__gone"))
    # a merge at every size: what is removed grows with the texts
    out = rows.join(gone.hint("merge"), (F.col(id_col).cast("long") == F.col("__id")) & (F.coalesce(F.xxhash64(text), F.lit(0)) == F.col("__tag")), "left")
    kept = F.filter(_split(text), lambda x, i: ~F.coalesce(F.get(F.col("__gone"), i), F.lit(False)))
    return out.withColumns(
        {
            "n_lines": F.coalesce(F.size(_split(text)), F.lit(0)).cast("long"),
            "n_removed": F.coalesce(F.size(F.filter("__gone", lambda x: x)), F.lit(0)).cast("long"),
            text_col: F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")),
        }
    ).drop("__id", "__tag", "__gone")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: aligned lines removed from all documents."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
