"""Collocations against plain Python: counts, cuts, drops and ranks; cut texts; saturated counters."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for p in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
        yield re.findall(r"[^ \t]+", p)


def plain(docs, least, top, kept=80):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    rows = []
    for lang, count in f.items():
        often = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        out = []
        for p, a in often.items():
            holds = any(len(q) > len(p) and 100 * b >= kept * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in often.items())
            if not holds:
                score, k = min((2000000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p)))
                out.append((-score, -a, " ".join(p).encode(), p, count[p[:k]], count[p[k:]]))
        rows += [(lang, i, " ".join(p), -a, left, right, n[lang], -s) for i, (s, a, _, p, left, right) in enumerate(sorted(out)[:top], 1)]
    return sorted(rows)


def got(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def made(n, seed):
    r = random.Random(seed)
    words = ["New", "york", "CITY", "hall", "été", "ﬀ", "a-b", "zz\tq", "語"] + [f"w{i}" for i in range(6)]
    text = lambda: "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n"]) for _ in range(r.randrange(80)))
    return [(r.choice(["en", "en", "de", None, "und"]), text() + r.choice(["", "new york city hall "] * 2)) for _ in range(n)]


@pytest.mark.parametrize(("least", "counters", "top"), [(4, 1 << 16, 1000), (9, 512, 7)])
def test_against_plain_python(spark, least, counters, top):
    """Small tables of counters rule out nothing and change nothing; ranges begin inside runs of one first word."""
    docs = made(300, least) + [("en", None), (None, None), ("en", ""), ("fr", " . , "), ("en", "one one one " * 40), ("en", "one one one " * 40)]
    df = spark.createDataFrame(docs, "lang string, text string").withColumns({c: F.lit(1) for c in ("part", "words", "f", "n", "score", "doc_id")})
    want = plain(docs, least, top)
    assert len(want) > 20 and got(collocations.collocations(df, least, top, most_counters=counters)) == want


def test_empty(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(none).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", "a b c"), ("en", None)], none.schema)).count() == 0


def test_texts_cut_between_words(monkeypatch):
    """A long text in parts gives the counts of the whole."""
    monkeypatch.setattr(collocations, "PIECE", 50)
    monkeypatch.setattr(collocations, "BEHIND", 4)
    docs = [*made(4, 5), ("en", "x" * 400 + " Y " + "z" * 90 + " q. r"), ("en", " " * 300), ("de", "a b c d e f g h " * 60)]
    batch = pa.RecordBatch.from_arrays([pa.array([lang or "und" for lang, _ in docs]), pa.array([t for _, t in docs])], ["lang", "text"])
    rows = pa.Table.from_batches(collocations._merged(collocations._counted(collocations.Counters(512), 3)(iter([batch])))).to_pylist()
    want = Counter()
    for lang, text in docs:
        for w in pieces(text):
            if w:
                want[lang or "und", ""] += len(w)
            for k in range(1, 5):
                want.update((lang or "und", " ".join(w[i : i + k])) for i in range(len(w) - k + 1))
    assert {(r["lang"], r["phrase"]): r["f"] for r in rows} == dict(want)


def test_ranges_of_one_word(spark):
    """Streams whose ranges all begin with the same words: beginnings stand in earlier ranges, extensions in later ones."""
    rows = [("en", ["a"], 900)] + [("en", ["a", f"b{i % 30:02d}", *([f"c{i}"] if i >= 30 else [])], 500 - i) for i in range(300)]
    df = spark.createDataFrame(rows, "lang string, words array<string>, f long")
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = {tuple(r.words): (r.parts, r.longest) for r in collocations.stream(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    count = {tuple(w): f for _, w, f in rows}
    want = {w: ([count[w[:k]] for k in range(1, len(w))], max((f for q, f in count.items() if len(q) == len(w) + 1 and q[: len(w)] == w), default=0)) for w in count if len(w) > 1}
    assert out == want
