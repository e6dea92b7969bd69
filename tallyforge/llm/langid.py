"""Language identification with spans of mixed-language text.

Words are runs of letters. A word's script, read off code point ranges, leaves only the languages that use the script;
each of those scores the word by the letter trigrams around its letters. A Viterbi pass with a penalty for each switch
labels the words of a document, and runs of equal labels are its spans. The document's language is the one that labels
most of its letters.

The Viterbi pass is exact and works on whole arrays: documents are cut into chunks of words, every chunk yields its best
score for each pair of entry and exit language, chunks are chained document by document, and a second pass inside the
chunks, whose ends are then known, reads off the path. Scores are integers, so that no order of additions matters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import last_ticket, row_pieces, row_slices, text_bytes, ticket

#: First and last code point of scripts' blocks.
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("arabic", 0x0750, 0x077F), ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF), ("tamil", 0x0B80, 0x0BFF),
    ("telugu", 0x0C00, 0x0C7F), ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F), ("sinhala", 0x0D80, 0x0DFF),
    ("thai", 0x0E00, 0x0E7F), ("lao", 0x0E80, 0x0EFF), ("tibetan", 0x0F00, 0x0FFF), ("burmese", 0x1000, 0x109F),
    ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("ethiopic", 0x1200, 0x137F), ("khmer", 0x1780, 0x17FF),
    ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7A3), ("han", 0x20000, 0x3FFFF),
]
SCRIPT_NAMES = ["other", *dict.fromkeys(s for s, _, _ in SCRIPTS)]
#: Share of a language's letters that a script needs to count as the language's.
SCRIPT_SHARE = 0.01
BUCKETS = 1 << 16
#: Scores are in 1/64 of a natural log.
UNIT = 64
SWITCH = 8 * UNIT
CHUNK = 64
NEVER = -(1 << 40)
#: Documents a language is learned from, about; they are chosen by a hash of doc_id, never by position.
LEARN = 2000
#: Code points.
_LIMIT = 0x110000
#: Bytes of the arrays that one Viterbi pass may take, about; a longer document stands alone.
PASS_BYTES = 64 << 20


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: is it part of a word, is it a letter, and its script."""
    kinds = [unicodedata.category(chr(i)) for i in range(_LIMIT)]
    letter = np.array([k[0] == "L" for k in kinds])
    inside = letter | np.array([k[0] == "M" for k in kinds])
    script = np.zeros(_LIMIT, np.int8)
    for name, a, b in SCRIPTS:
        script[a : b + 1] = SCRIPT_NAMES.index(name)
    return inside, letter, script


def words_by_script(text: str, rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """(word starts, word ends, row of each word, letters, script, trigram bucket of each character of a word).

    ``text`` holds all rows one after the other and ``rows`` their n + 1 first characters.
    """
    inside, letter, script = _tables()
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    solid = inside[code]
    edge = np.zeros(len(code) + 1, bool)
    edge[rows] = True
    kind = np.where(solid, script[code], -1)
    starts = np.flatnonzero(solid & (np.r_[True, kind[1:] != kind[:-1]] | edge[:-1]))
    ends = np.flatnonzero(solid & (np.r_[kind[1:] != kind[:-1], True] | edge[1:])) + 1
    here = code.astype(np.uint64)
    left, right = np.zeros_like(here), np.zeros_like(here)
    left[1:], right[:-1] = here[:-1], here[1:]
    left[starts] = 0
    right[ends - 1] = 0
    bucket = (((left * np.uint64(0x9E3779B1) + here) * np.uint64(0x85EBCA77) + right) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(48)
    letters = np.add.reduceat(np.r_[letter[code], False].astype(np.int64), np.stack([starts, ends], 1).ravel())[::2] if len(starts) else np.zeros(0, np.int64)
    return starts, ends, np.searchsorted(rows, starts, side="right") - 1, letters, kind[starts], bucket.astype(np.int64)


def _joined(piece: pa.Array) -> tuple[str, np.ndarray]:
    """The lower-case texts as one string, and where each begins in it."""
    texts = [t or "" for t in piece.to_pylist()]
    return "".join(texts), np.cumsum([0, *map(len, texts)])


# --------------------------------------------------------------------------- the model


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Letter counts by language and bucket; scripts have the buckets from BUCKETS on."""
    for batch in batches:
        for piece in row_pieces(batch, "text"):
            text, rows = _joined(piece.column(1))
            starts, ends, row, letters, script, bucket = words_by_script(text, rows)
            names, number = np.unique(np.array(piece.column(0).to_pylist(), object).astype(str), return_inverse=True)
            if not len(starts):
                continue
            held = np.repeat(np.arange(len(starts)), ends - starts)
            at = np.arange(len(held)) - np.repeat(np.cumsum(ends - starts) - (ends - starts), ends - starts) + np.repeat(starts, ends - starts)
            keys = np.r_[number[row[held]] * (2 * BUCKETS) + bucket[at], number[row] * (2 * BUCKETS) + BUCKETS + script]
            keys, n = np.unique(np.repeat(keys, np.r_[np.ones(len(held), np.int64), letters]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names[keys // (2 * BUCKETS)].tolist(), pa.string()), pa.array((keys % (2 * BUCKETS)).astype(np.int32)), pa.array(n.astype(np.int64))], ["lang", "bucket", "n"])


class Model:
    """Languages (most learned-from first), their trigram scores and the scripts they use."""

    def __init__(self, langs: list[str], buckets: np.ndarray, counts: np.ndarray) -> None:
        names, at = np.unique(np.array(langs, object).astype(str), return_inverse=True)
        names = names.tolist()
        grams = np.zeros((len(names), BUCKETS))
        scripts = np.zeros((len(names), len(SCRIPT_NAMES)))
        gram = buckets < BUCKETS
        np.add.at(grams, (at[gram], buckets[gram]), counts[gram])
        np.add.at(scripts, (at[~gram], buckets[~gram] - BUCKETS), counts[~gram])
        order = np.argsort(-grams.sum(axis=1), kind="stable")
        self.languages = [names[i] for i in order]
        grams, scripts = grams[order], scripts[order]
        chance = np.log((grams + 0.1) / (grams.sum(axis=1, keepdims=True) + 0.1 * BUCKETS)) if names else grams
        self.scores = np.ascontiguousarray(np.rint(chance * UNIT).astype(np.int32).T)
        self.uses = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1)

    def word_scores(self, starts: np.ndarray, ends: np.ndarray, script: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score of each word in each language, relative to the word's best, and whether any language may have it."""
        out = np.zeros((len(starts), len(self.languages)), np.int64)
        if not len(starts):
            return out, np.zeros(0, bool)
        pairs = np.stack([starts, ends], 1).ravel()
        at = np.append(bucket, 0)
        for i in range(len(self.languages)):
            out[:, i] = np.add.reduceat(self.scores[:, i][at].astype(np.int64), pairs)[::2]
        may = self.uses.T[script]
        some = may.any(axis=1)
        out = np.where(may, out, out.min() - SWITCH * 4)
        out -= out.max(axis=1, keepdims=True)
        out[~some] = 0
        return out, some


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = LEARN) -> Model:
    """A model from about ``most`` rows of each language; only text and language are read, doc_id picks the rows.

    Rows without text or language teach nothing. The model holds languages x 2**16 integers, whatever the input.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.lower(F.col(text_col).cast("string")).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    held = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not held:
        return Model([], np.zeros(0, np.int64), np.zeros(0, np.int64))
    limit = F.create_map(*[x for lang, n in held.items() for x in (F.lit(lang), F.lit(last_ticket(most, n)))])
    sample = rows.where(ticket("learn", F.col("doc_id")) <= limit[F.col("lang")]).select("lang", "text")
    counts = sample.mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.toArrow()  # at most languages x 2**16 rows of numbers, whatever the input
    return Model(found.column("lang").to_pylist(), found.column("bucket").to_numpy(), found.column("n").to_numpy())


# --------------------------------------------------------------------------- the path


def viterbi(scores: np.ndarray, rows: np.ndarray, penalty: int = SWITCH, chunk: int = CHUNK) -> np.ndarray:
    """The best label of each word: labels of a row's words maximise their scores less ``penalty`` a switch.

    ``rows`` has the n + 1 first words of the rows; scores are integers, words x labels. Rows are taken together as long
    as their chunks, with a square of labels each, stay within PASS_BYTES.
    """
    n_words, labels = scores.shape
    if not n_words:
        return np.zeros(0, np.int64)
    cost = np.cumsum(np.r_[0, -(-np.diff(rows) // chunk)]) * labels * (2 * chunk + labels) * 8
    if cost[-1] > PASS_BYTES and len(rows) > 2:
        parts = row_slices(cost, PASS_BYTES)
        return np.concatenate([viterbi(scores[rows[lo] : rows[hi]], rows[lo : hi + 1] - rows[lo], penalty, chunk) for lo, hi in parts])
    sizes = np.diff(rows)
    per_row = -(-sizes // chunk)
    first = np.cumsum(per_row) - per_row
    row = np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(n_words) - rows[row]
    where = first[row] + within // chunk, within % chunk
    cells = np.zeros((int(per_row.sum()), chunk, labels), np.int64)
    cells[where] = scores
    # best score of each chunk by entry and exit label
    through = np.full((len(cells), labels, labels), NEVER, np.int64)
    through[:, np.arange(labels), np.arange(labels)] = 0
    for t in range(chunk):
        through = np.maximum(through, through.max(axis=2, keepdims=True) - penalty) + cells[:, t, None, :]
    # chain the chunks of each row
    entry = np.zeros((len(cells), labels), np.int64)
    order = np.argsort(-per_row, kind="stable")
    counts = per_row[order]
    last = np.zeros((len(sizes), labels), np.int64)
    for j in range(int(per_row.max())):
        live = order[: np.searchsorted(-counts, -j, side="left")]
        at = first[live] + j
        entry[at] = last[live]
        last[live] = (entry[at][:, :, None] + through[at]).max(axis=1)
    leave = np.zeros(len(cells), np.int64)
    enter = np.zeros(len(cells), np.int64)
    state = last.argmax(axis=1)
    for j in range(int(per_row.max()) - 1, -1, -1):
        live = order[: np.searchsorted(-counts, -j, side="left")]
        at = first[live] + j
        leave[at] = state[live]
        enter[at] = (entry[at] + through[at, :, state[live]]).argmax(axis=1)
        state[live] = enter[at]
    # the path inside each chunk, whose ends are known
    value = np.full((len(cells), labels), NEVER, np.int64)
    each = np.arange(len(cells))
    value[each, enter] = 0
    stays = np.empty((chunk, len(cells), labels), bool)
    froms = np.empty((chunk, len(cells)), np.int8 if labels < 128 else np.int32)
    for t in range(chunk):
        froms[t] = value.argmax(axis=1)
        switched = value.max(axis=1, keepdims=True) - penalty
        stays[t] = value >= switched
        value = np.maximum(value, switched) + cells[:, t]
    path = np.empty((len(cells), chunk), np.int64)
    now = leave
    for t in range(chunk - 1, -1, -1):
        path[:, t] = now
        now = np.where(stays[t, each, now], now, froms[t])
    return path[where]


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))


def _label(model: Model):
    """Takes the lower-case text as the last column and returns the columns before it with the three of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*model.languages, "und"], pa.string())
        und = len(model.languages)
        for batch in batches:
            own = batch.schema.names[:-1]
            for piece in row_pieces(batch, batch.schema.names[-1]):
                text, chars = _joined(piece.column(len(own)))
                starts, ends, row, letters, script, bucket = words_by_script(text, chars)
                n = piece.num_rows
                if not und:
                    starts, ends, row, letters, script = (x[:0] for x in (starts, ends, row, letters, script))
                scores, some = model.word_scores(starts, ends, script, bucket)
                label = viterbi(scores, np.searchsorted(row, np.arange(n + 1)))
                total = np.bincount(row, letters, n)
                mine = np.bincount((row * max(und, 1) + label)[some], letters[some], n * max(und, 1)).reshape(n, -1)
                best = np.where(total > 0, mine.argmax(axis=1), und)
                share = np.where(total > 0, mine.max(axis=1) / np.maximum(total, 1), 0.0)
                tag = np.where(some, label, und)
                new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (tag[1:] != tag[:-1])]) if len(row) else np.zeros(0, np.int64)
                close = np.r_[new[1:], len(row)] - 1 if len(new) else new
                base = chars[row[new]]
                spans = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(row[new], np.arange(n + 1)).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array((starts[new] - base).astype(np.int32)), pa.array((ends[close] - base).astype(np.int32)), names.take(pa.array(tag[new]))], ["start", "end", "lang"]),
                )
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], names.take(pa.array(best)), pa.array(share), spans.cast(_SPANS)], [*own, "lang_pred", "score", "spans"])

    return run


def label(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with lang_pred, score (share of the letters that lang_pred labels) and spans (start, end, lang).

    Spans are in characters of the lower-cased text. Null texts and texts without a letter are ``und`` with score 0 and
    no spans; so is every text if the model knows no language. Words in a script that no language uses are labelled
    ``und``; a text of nothing else gets the language that most was learned from, with score 0. Equal shares go to the
    language that more was learned from. Repeated rows are labelled one by one; an empty table gives an empty result.
    Columns of the three names are replaced; others are neither read nor changed.
    """
    rows = docs.drop("lang_pred", "score", "spans")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"])
    return rows.withColumn("__lower", F.lower(F.col(text_col).cast("string"))).mapInArrow(_label(model), schema)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and spans of every row; see ``label``."""
    lower = F.lower(F.col(text_col).cast("string")).alias("lower")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), lower).mapInArrow(_label(model), "doc_id long, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether a document is kept from learning: crc32 of its doc_id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the language of all documents, learned from those not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs.where("doc_id is not null").where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
