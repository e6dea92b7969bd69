"""SentencePiece encoding and decoding: Viterbi with forward scores shared along common prefixes.

The distinct marked words of a batch are sorted, which is a depth-first walk of their trie: a word keeps the forward
scores of the prefix it shares with the word before it and extends them character by character. A unigram model takes
the best-scored piece that ends at each character. In a BPE model a piece may follow another only if merging the two
together leaves exactly those two; then one piece fits at each character and the best path is the one that merging by
score finds, which makes ids equal to the library's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import hash_spans, row_pieces, text_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
LOST = float("-inf")
#: Pairs of pieces that a worker remembers between tasks.
KNOWN_PAIRS = 400_000
#: Bytes of text that are encoded together; more share more prefixes and take more memory.
TOGETHER = 4 << 20


#: Lengths that are tried after any three characters.
SHORT = (2, 1)


def tails_of(pieces: dict[str, int]) -> dict[str, tuple[int, ...]]:
    """The lengths worth trying after each three characters: of the pieces that end in them, longest first, and SHORT."""
    out: dict[str, set[int]] = {}
    for p in pieces:
        if len(p) > 2:
            out.setdefault(p[-3:], set()).add(len(p))
    return {t: (*sorted(n, reverse=True), *SHORT) for t, n in out.items()}


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value

    while at < len(message):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if tag & 7 == 2 else {1: 8, 5: 4}[tag & 7]
            at += size
            yield tag >> 3, message[at - size : at]


def check_model(model: bytes, merges: bool) -> None:
    """Raises ValueError unless the model is BPE (``merges``) or unigram, and changes no text but by the mark."""
    spec = {2: b"", 3: b""} | {k: v for k, v in _fields(model) if k in (2, 3)}
    kind = dict(_fields(spec[2])).get(3, 1)  # 1 unigram, 2 BPE; the default is unigram
    normal = {3: 1, 4: 1, 5: 1} | dict(_fields(spec[3]))
    if kind != (2 if merges else 1):
        raise ValueError(f"the model is of type {kind}, but merges is {merges}")
    if normal.get(2) or normal[4] or not normal[3] or not normal[5]:
        raise ValueError("the model normalises text, drops spaces or adds no mark before it: its ids would differ")


class Pieces:
    """A model's pieces, and the segmentation of single marked words."""

    def __init__(self, model: bytes, merges: bool = True) -> None:
        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = library.get_piece_size()
        special = [library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i) for i in range(n)]
        self.merges = merges
        self.piece = [library.id_to_piece(i) for i in range(n)]
        self.score = [library.get_score(i) for i in range(n)]
        self.id = {p: i for i, p in enumerate(self.piece) if not special[i]}
        self.byte = {int(p[1:-1], 16): i for i, p in enumerate(self.piece) if library.is_byte(i)}
        self.unknown = library.unk_id()
        self.follows: dict[int, bool] = {}
        #: Pieces that can stand in a path, and the lengths (longest first) of those that end in given characters.
        self.whole = {p: i for p, i in self.id.items() if not merges or self.merged(p) == [p]}
        self.tails = tails_of(self.whole)
        #: Characters that no piece joins to another: they stand alone, so text is cut at them.
        joined = {c for p in self.id if len(p) > 1 for c in p}
        self.alone = np.array([i for i in range(128) if chr(i) not in joined and chr(i) != " "], np.uint8)
        raw = [b"" if special[i] and not library.is_byte(i) else bytes([int(p[1:-1], 16)]) if library.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.piece)]
        self.bytes_at = np.cumsum([0, *map(len, raw)])
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)

    def merged(self, text: str) -> list[str]:
        """Merge neighbours by best score, the leftmost of equals, until none fits."""
        parts = list(text)
        while len(parts) > 1:
            best, at = LOST, -1
            for i in range(len(parts) - 1):
                k = self.id.get(parts[i] + parts[i + 1])
                if k is not None and self.score[k] > best:
                    best, at = self.score[k], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, before: int, after: int) -> bool:
        pair = before << 32 | after
        known = self.follows.get(pair)
        if known is None:
            a, b = self.piece[before], self.piece[after]
            known = self.follows[pair] = self.merged(a + b) == [a, b]
        return known

    def encode_sorted(self, words: list[str]) -> list[list[int]]:
        """Ids of each word; the words come sorted and marked."""
        out: list[list[int]] = []
        best, start, last = [0.0], [0], [-1]  # forward score, and the best path's last piece, by position
        previous = ""
        whole, score, tails, follows, merges = self.whole.get, self.score, self.tails.get, self.follows.get, self.merges
        for word in words:
            same = 0
            for x, y in zip(previous, word, strict=False):
                if x != y:
                    break
                same += 1
            del best[same + 1 :], start[same + 1 :], last[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                top, at, piece = LOST, end - 1, -1
                for n in tails(word[end - 3 : end], SHORT) if end > 2 else SHORT:
                    if n > end:
                        continue
                    begin = end - n
                    k = whole(word[begin:end])
                    if k is None:
                        continue
                    if merges:
                        before = last[begin]
                        if before >= 0:
                            known = follows(before << 32 | k)
                            if not (self.fits(before, k) if known is None else known):
                                continue
                        top, at, piece = best[begin] + score[k], begin, k
                        break  # no other piece fits here
                    if best[begin] + score[k] > top:
                        top, at, piece = best[begin] + score[k], begin, k
                if piece < 0:  # no piece has this character
                    top = best[end - 1] - 1e6
                best.append(top)
                start.append(at)
                last.append(piece)
            path, end = [], len(word)
            while end:
                if last[end] >= 0:
                    path.append(last[end])
                else:
                    raw = word[end - 1].encode()
                    path += [self.byte[b] for b in reversed(raw)] if self.byte else [self.unknown]
                end = start[end]
            out.append(path[::-1])
            previous = word
        return out

    def encode(self, body: bytes, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows and where each row's begin; ``body`` has the rows one after the other."""
        texts = [body[a:b].replace(MARK.encode(), b" ") for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]
        marked = [b" " + t if t else b"" for t in texts]
        first = np.cumsum([0, *map(len, marked)])
        data = np.frombuffer(b"".join(marked), np.uint8)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(rows), np.int64)
        space, alone = data == 32, np.isin(data, self.alone)
        opens = np.zeros(len(data) + 1, bool)
        opens[first] = True
        opens[:-1] |= alone
        opens[1:] |= alone
        opens[1:-1] |= space[1:] & ~space[:-1]
        starts = np.flatnonzero(opens[:-1])
        ends = np.r_[starts[1:], len(data)]
        _, sample, number = np.unique(hash_spans(data, starts, ends), return_index=True, return_inverse=True)
        raw = data.tobytes()
        words = [raw[a:b].decode().replace(" ", MARK) for a, b in zip(starts[sample].tolist(), ends[sample].tolist(), strict=True)]
        order = sorted(range(len(words)), key=words.__getitem__)
        found: list[list[int]] = [[]] * len(words)
        for i, path in zip(order, self.encode_sorted([words[i] for i in order]), strict=True):
            found[i] = path
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((k for x in found for k in x), np.int32, int(sizes.sum()))
        counts = sizes[number]
        ids = _gather(flat, np.cumsum(sizes) - sizes, number, counts)
        total = np.r_[0, np.cumsum(counts)]
        return ids, total[np.searchsorted(starts, first)]

    def decode(self, ids: np.ndarray, rows: np.ndarray) -> list[bytes]:
        """The text of each row, without the mark put before its first word."""
        sizes = np.diff(self.bytes_at)[ids]
        raw = _gather(self.bytes, self.bytes_at[:-1], ids, sizes).tobytes()
        at = np.r_[0, np.cumsum(sizes)][rows]
        return [raw[a:b][raw[a:b][:1] == b" " :] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _gather(values: np.ndarray, begins: np.ndarray, which: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """values[begins[w] : begins[w] + count] for each w, one after the other."""
    total = int(counts.sum())
    shift = np.repeat(begins[which] - (np.cumsum(counts) - counts), counts)
    return values[shift + np.arange(total)]


_LOADED: dict[int, Pieces] = {}


def _pieces(model, merges: bool) -> Pieces:
    """The worker's copy, which keeps what it has learned about pairs of pieces from task to task."""
    key = hash((model.value, merges))
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pieces(model.value, merges)
    out = _LOADED[key]
    if len(out.follows) > KNOWN_PAIRS:
        out.follows.clear()
    return out


def _with(piece: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*piece.columns, column], [*piece.schema.names, name])


def _encode(model, merges: bool, text_col: str, back: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model, merges)
        for batch in batches:
            for piece in row_pieces(batch, text_col, TOGETHER):
                texts = piece.column(piece.schema.get_field_index(text_col))
                body, at = text_bytes(texts)
                ids, rows = pieces.encode(body[at[0] : at[-1]].tobytes(), at - at[0])
                none = texts.is_null()
                out = _with(piece, "ids", pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(ids), mask=none))
                yield _with(out, "decoded", _texts(pieces, ids, rows, none)) if back else out

    return run


def _texts(pieces: Pieces, ids: np.ndarray, rows: np.ndarray, none: pa.Array) -> pa.Array:
    return pa.array([None if n else t for n, t in zip(none.to_pylist(), pieces.decode(ids, rows), strict=True)], pa.binary())


def _decode(model, merges: bool, ids_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model, merges)
        for batch in batches:
            step = 256
            for i in range(0, batch.num_rows, step):
                piece = batch.slice(i, step)
                lists = piece.column(piece.schema.get_field_index(ids_col))
                sizes = lists.value_lengths().fill_null(0).to_numpy()
                yield _with(piece, "decoded", _texts(pieces, lists.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(sizes)], lists.is_null()))

    return run


def _shared(spark: SparkSession, model_path: str, merges: bool):
    """The model file's bytes (fixed by the model, not by the corpus), sent to the executors once."""
    with open(model_path, "rb") as f:
        model = f.read()
    check_model(model, merges)
    return spark.sparkContext.broadcast(model)


def _schema(df: DataFrame, *more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *more])


def encode(docs: DataFrame, text_col: str = "text", model_path: str = MODEL, merges: bool = True) -> DataFrame:
    """All columns of ``docs`` and ids, an array of piece ids.

    ``merges`` tells a BPE model from a unigram one; a model of the other kind, or with a normaliser that changes texts,
    raises ValueError. A null text has null ids, an empty text no ids. The mark character
    U+2581 in a text counts as a space, as in the library. Characters that no piece has become byte pieces. A column
    named ids is replaced; rows are encoded one by one, whatever else they hold.
    """
    rows = docs.drop("ids").withColumn(text_col, F.col(text_col).cast("string"))
    return rows.mapInArrow(_encode(_shared(docs.sparkSession, model_path, merges), merges, text_col, False), _schema(rows, "ids array<int>"))


def round_trip(docs: DataFrame, text_col: str = "text", model_path: str = MODEL, merges: bool = True) -> DataFrame:
    """``encode`` and ``decode`` in one pass, which holds one copy of the model a task: ids and decoded."""
    rows = docs.drop("ids", "decoded").withColumn(text_col, F.col(text_col).cast("string"))
    out = rows.mapInArrow(_encode(_shared(docs.sparkSession, model_path, merges), merges, text_col, True), _schema(rows, "ids array<int>", "decoded binary"))
    return out.withColumn("decoded", _valid("decoded"))


def decode(tokens: DataFrame, ids_col: str = "ids", model_path: str = MODEL, merges: bool = True) -> DataFrame:
    """All columns of ``tokens`` and decoded, the text; ids of null give null, an empty array the empty text.

    Bytes that are no valid UTF-8 come out as replacement characters. A column named decoded is replaced.
    """
    rows = tokens.drop("decoded")
    out = rows.mapInArrow(_decode(_shared(tokens.sparkSession, model_path, merges), merges, ids_col), _schema(rows, "decoded binary"))
    return out.withColumn("decoded", _valid("decoded"))


def _valid(column: str) -> Column:
    return F.make_valid_utf8(F.col(column).cast("string"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: all documents encoded and decoded again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = round_trip(docs)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))
