"""SimHash near-dedup: a byte-position inverted index with count filtering.

Fingerprints within two bits share at least six of their eight positional bytes, so among the four byte pairs
(0,1) (2,3) (4,5) (6,7) two are shared whole. Posting lists are keyed by those two byte pairs. Within a list the shared
positional bytes of each pair are tallied; pairs that reach six are verified with the bit distance, and the list's links
leave as stars, never as all pairs. Fingerprints of a list longer than ``tallied`` are keyed by six positional bytes
instead, which any pair that reaches six has in common; such a list has at most 2**16 fingerprints, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .shared import discard, materialize, row_pieces, text_bytes

SHINGLE = 3
DISTANCE = 2
#: Matches that two fingerprints within DISTANCE bits are sure to have among their 8 positional bytes.
SHARED_BYTES = 8 - DISTANCE
#: The 16-bit blocks whose pairs key the posting lists.
BLOCKS = [0xFFFF << s for s in (48, 32, 16, 0)]
MASKS = [a | b for a, b in combinations(BLOCKS, 2)]
#: The six positional bytes that key the lists of fingerprints from long lists.
SIXES = [sum(0xFF << 8 * i for i in kept) for kept in combinations(range(8), SHARED_BYTES)]
#: Longest posting list of two byte pairs; longer ones are keyed by six bytes.
TALLIED = 256
#: Rows of a list that are compared with the others in one step.
ROWS = 256


# --------------------------------------------------------------------------- fingerprints


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit majority fingerprint of a text; zero for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(shingle, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    ones, digest, step = np.zeros(64, np.int64), xxhash.xxh64_digest, 1 << 15
    for i in range(0, len(starts), step):
        hashes = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[i : i + step], ends[i : i + step], strict=True)])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def _fingerprint_rows(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in row_pieces(batch, "text", 8 << 20):
                body, at = text_bytes(piece.column(1))
                prints = [fingerprint(body[at[i] : at[i + 1]].tobytes(), shingle) for i in range(piece.num_rows)]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], ["doc_id", "print"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, print): the fingerprint as a signed long. Null and wordless texts have fingerprint zero."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprint_rows(shingle), "doc_id long, print long")


# --------------------------------------------------------------------------- links within posting lists


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable over the links a-b, for n items."""
    root = np.arange(n)
    while len(a):
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def list_links(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars over the links of one posting list of different fingerprints."""
    n = len(prints)
    byte = np.ascontiguousarray(prints).view(np.uint8).reshape(n, 8)
    found = []
    for low in range(0, n, ROWS):
        mine = slice(low, low + ROWS)
        tally = np.zeros((len(prints[mine]), n - low), np.uint8)
        for i in range(8):
            tally += byte[mine, i][:, None] == byte[low:, i][None, :]
        a, b = np.nonzero(tally >= SHARED_BYTES)
        a, b = a[a < b] + low, b[a < b] + low
        near = np.bitwise_count(prints[a] ^ prints[b]) <= DISTANCE
        found.append((a[near], b[near]))
    root = _roots(n, *(np.concatenate(x) for x in zip(*found, strict=True)))
    moved = np.flatnonzero(root != np.arange(n))
    return prints[moved], prints[root[moved]]


def _posting_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (table, key): links of each list, with the list that the batch cuts carried over."""
    held_list, held = None, np.zeros(0, np.uint64)

    def links(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return list_links(prints) if len(prints) > 1 else (prints[:0], prints[:0])

    for batch in batches:
        table, key = (batch.column(i).to_numpy() for i in (0, 1))
        prints = batch.column(2).to_numpy().view(np.uint64)
        if not len(table):
            continue
        cuts = np.r_[0, np.flatnonzero((table[1:] != table[:-1]) | (key[1:] != key[:-1])) + 1, len(table)]
        out = []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if (table[lo], key[lo]) != held_list:
                if held_list:
                    out.append(links(held))
                held_list, held = (table[lo], key[lo]), prints[lo:hi].copy()
            else:
                held = np.r_[held, prints[lo:hi]]
        a, b = (np.concatenate([x[i] for x in out]) if out else held[:0] for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
    if held_list:
        a, b = links(held)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(prints: DataFrame, masks: list[int]) -> DataFrame:
    return prints.select("print", F.posexplode(F.array(*[F.col("print").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("table", "key"))


def _listed(held: DataFrame) -> DataFrame:
    """(a, b): links of the posting lists of rows (table, key, print)."""
    return held.select("table", "key", "print").repartition("table", "key").sortWithinPartitions("table", "key", "print").mapInArrow(_posting_links, "a long, b long")


def print_links(prints: DataFrame, tallied: int = TALLIED) -> DataFrame:
    """(a, b): links that connect the different fingerprints (column print) exactly as all pairs within two bits do."""
    keyed = _keyed(prints, MASKS)
    # written, so that the join is between two exchanges and Spark can split a long list
    lists = materialize(keyed.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "lists")
    held = materialize(keyed.join(lists, ["table", "key"]), "postings")
    long = materialize(held.where(F.col("n") > tallied).select("print").distinct(), "long-lists")
    sixes = _keyed(long, SIXES)
    shared = materialize(sixes.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("table", "key"), "lists-of-six")
    links = materialize(_listed(held.where(F.col("n") <= tallied)).unionByName(_listed(sixes.join(shared, ["table", "key"]))), "links")
    for table in (lists, held, long, shared):
        discard(table)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, tallied: int = TALLIED) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links of at most two bits.

    Copies share a fingerprint, which is indexed once however many documents have it. Null, empty and wordless texts
    have fingerprint zero and are linked like any other. Repeated rows come back as often as they came in; rows without
    doc_id get a fingerprint and a component but never name one. An empty table gives an empty result; other columns are
    not read.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, shingle), "prints")
    first = materialize(prints.groupBy("print").agg(F.min("doc_id").alias("first")), "first-docs")
    member = connected_components(print_links(first.select("print"), tallied))
    held = first.join(member, F.col("print") == F.col("node"), "left").select("print", "first", F.coalesce("component", "print").alias("class"))
    least = held.groupBy("class").agg(F.min("first").alias("component_id"))
    named = held.join(least, "class").select("print", "component_id")
    return prints.join(named, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: near-duplicate classes of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
