"""Importance resampling against plain Python: weights, scores, ranks, and the radix sort on its own."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import resample

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


def plain(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, runs(text)[1]))
    for text in target:
        t.update(map(bucket, runs(text)[1]))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000))))
    rows, taking = [], []
    for i, (doc_id, text) in enumerate(docs):
        n, f = runs(text)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if n >= 20:
                taking.append((-score, doc_id, i))
        rows.append([doc_id, len(f), weight, score, None])
    for rank, (_, _, i) in enumerate(sorted(taking)[: 25 * len(taking) // 100], 1):
        rows[i][4] = rank
    return sorted(map(tuple, rows), key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=repr)


def made(n, seed=1):
    r = random.Random(seed)
    words = ["Alpha", "beta,", "GAMMA", "été", "ÉTÉ", "x1", "don't", "語" * 40, "z" * 90, "--", "q"]
    return [(i - 20, " ".join(r.choice(words) for _ in range(r.randrange(60)))) for i in range(n)]


@pytest.mark.parametrize("piece", [resample.PIECE, 64])
def test_against_plain_python(spark, monkeypatch, piece):
    docs = made(150) + [(None, "no id " * 30), (500, None), (501, ""), (502, "..."), (7, "twice " * 25), (7, "twice " * 25), (1 << 40, "far away " * 20), (600, "w" * 300 + " end of it")]
    goal = ["alpha beta gamma", None, "x1 q", ""]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("score", "rank", "at", "weight", "n_words", "block", "place")})
    if piece != resample.PIECE:  # cut rows only in this process, on the kernel itself
        monkeypatch.setattr(resample, "PIECE", piece)
        batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs]), pa.array([t for _, t in docs])], ["doc_id", "text"])
        seen = [np.stack(s[:2], 1) for _, s in resample.features(iter([batch]), lambda of, bucket, n: [np.bincount(of, bucket, n)])]
        sums = np.concatenate([s[2] for _, s in resample.features(iter([batch]), lambda of, bucket, n: [np.bincount(of, bucket, n)])])
        assert np.concatenate(seen).tolist() == [[runs(t)[0], len(runs(t)[1])] for _, t in docs]
        assert sums.tolist() == [sum(zlib.crc32(f.encode()) % 10000 for f in runs(t)[1]) for _, t in docs]
        return
    assert got(resample.resample(df, spark.createDataFrame([(g,) for g in goal], "text string"))) == plain(docs, goal)


def test_empty(spark):
    docs, goal = spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string"), spark.createDataFrame([("a",)], "text string")
    assert resample.resample(docs.where("false"), goal).count() == 0
    assert got(resample.resample(docs, goal.where("false"))) == plain([(1, "a b " * 20)], [])
    many = [(i, "a b " * 10) for i in range(8)]  # one weight, ranks by noise
    assert got(resample.resample(spark.createDataFrame(many, "doc_id long, text string"), goal)) == plain(many, ["a"])


def test_words_of_every_length():
    text = "".join("abcdefgh0é"[i % 10] * (i % 130) + " " for i in range(400)).encode()
    body = np.frombuffer(text, np.uint8)
    spans = [(m.start(), m.end()) for m in re.finditer(rb"[^ ]+", text)]
    a, b = np.array(spans).T
    crc = resample.crc_words(body, a, b)
    assert crc.tolist() == [zlib.crc32(text[i:j]) for i, j in spans]
    both = resample.crc_joined(crc[:-1], crc[1:], body, a[1:], b[1:])
    assert both.tolist() == [zlib.crc32(text[i:j] + b" " + text[k:m]) for (i, j), (k, m) in zip(spans, spans[1:], strict=False)]


@pytest.mark.parametrize("low_bits", [64, 33, 5])
def test_radix_sort(spark, monkeypatch, low_bits):
    """Wide, straddling and narrow keys over many blocks, with ties that keep their order."""
    monkeypatch.setattr(resample, "BLOCK_ROWS", 50)
    r = random.Random(low_bits)
    keys = [(r.randrange(1 << 13), r.choice([r.randrange(1 << low_bits), 3])) for _ in range(1200)]
    signed = [(h, lo - (1 << 64) if lo >> 63 else lo) for h, lo in keys]
    rows = spark.createDataFrame(signed, "high long, low long").repartition(7).withColumn("at", F.monotonically_increasing_id()).persist()
    at = {x.at: (x.high, x.low % (1 << 64)) for x in rows.collect()}
    placed = {x.at: x.place for x in resample.radix_sorted(rows, 1200, 13, low_bits).collect()}
    assert sorted(placed.values()) == list(range(1200))
    assert [at[a] for a in sorted(placed, key=placed.get)] == sorted(at.values())
    rows.unpersist()
