"""The network's gradients and pooling against plain loops, long texts in parts, held-out accuracy, edges."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import toxicity
from tallyforge.llm.toxicity import FILTERS, WIDTHS, Network, padded


def looped(net, ids):
    """Filters over one document, window by window."""
    ids = [*(ids if len(ids) else [0]), *[0] * (max(WIDTHS) - 1)]
    starts = range(len(ids) - max(WIDTHS) + 1)
    out = []
    for w, taps, bias in zip(WIDTHS, net.taps, net.bias, strict=True):
        for f in range(FILTERS):
            out.append(max(0.0, max(sum(float(net.words[ids[s + j]] @ taps[j][:, f]) for j in range(w)) for s in starts) + float(bias[f])))
    return out


def some_docs(seed=3, n=12):
    rng = np.random.default_rng(seed)
    return [rng.integers(0, 40, k).astype(np.int32) for k in [0, 1, 2, 0, 3, *rng.integers(1, 60, n - 6), 0]]


def test_pooling():
    net, docs = Network(40), some_docs()
    net.bias = [b + 0.1 for b in net.bias]
    got = net.pooled(*padded(np.concatenate(docs), np.r_[0, np.cumsum([len(d) for d in docs])]), net.tables())
    np.testing.assert_allclose(got, [looped(net, d) for d in docs], atol=1e-5)


def test_gradients():
    """Every kind of parameter against differences of the loss."""
    net, docs = Network(40), some_docs(4)
    net.words, net.out, net.level = (x.astype(float) for x in (net.words, net.out, net.level))
    net.taps, net.bias = [x.astype(float) for x in net.taps], [x.astype(float) + 0.05 for x in net.bias]
    ids, rows = padded(np.concatenate(docs), np.r_[0, np.cumsum([len(d) for d in docs])])
    label, weight, keep = np.arange(len(docs)) % 2.0, np.linspace(0.5, 1.5, len(docs)), np.linspace(0.5, 1.5, len(net.out)).astype(np.float32)
    _, slopes = net.gradients(ids, rows, label, weight, keep)
    rng = np.random.default_rng(1)
    for p, g in zip(net.parameters(), slopes, strict=True):
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in p.shape)
            if p is net.words and at[0] == 0:
                continue
            old, e = p[at].copy(), 1e-6
            p[at] = old + e
            up, _ = net.gradients(ids, rows, label, weight, keep)
            p[at] = old - e
            down, _ = net.gradients(ids, rows, label, weight, keep)
            p[at] = old
            assert abs((up - down) / (2 * e) - float(g[at])) < 1e-5


def test_threshold():
    z, y = np.array([1.0, 2, 3, 4, 5, 6]), np.array([0, 0, 1, 0, 1, 1])
    assert toxicity.best_threshold(z, y, np.ones(6)) in (2.5, 4.5)
    assert toxicity.best_threshold(z, y, np.where(y == 0, 5.0, 1)) == 4.5
    assert toxicity.best_threshold(z, np.zeros(6), np.ones(6)) > 6 and toxicity.best_threshold(z, np.ones(6), np.ones(6)) < 1


def made(n=600):
    """Two languages; a toxic word, or a toxic pair of words that are clean apart."""
    rng = np.random.default_rng(7)
    rows, labels = [], []
    for i in range(n):
        lang = ("en", "de")[i % 2]
        words = [f"{lang}{w}" for w in rng.zipf(1.3, 60 + i % 30) % 400]
        kind = i % 7
        if kind == 0:
            words.insert(int(rng.integers(len(words))), "Vile!")
        if kind in (1, 2):
            at = int(rng.integers(len(words)))
            words[at:at] = ["get", "lost"] if kind == 1 else ["lost", "and", "get"]
        rows.append((i, " ".join(words), lang, "s"))
        labels.append((i, int(kind in (0, 1))))
    return rows, labels


@pytest.fixture(scope="module")
def learned(spark):
    rows, labels = made()
    docs, told = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    return docs, told, dict(labels), toxicity.learn(docs, told)


def test_held_out(learned):
    docs, _, label, model = learned
    rows = toxicity.toxicity(docs, model).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in label if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == label[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows) and set(model["names"]) == {"en", "de"}


def test_only_the_text_counts(spark, learned):
    """Labels of held-out rows teach nothing; lang, source and doc_id do not change a score."""
    docs, told, _, model = learned
    held = toxicity.held_out(F.col("doc_id"))
    again = toxicity.learn(docs, told.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    score = lambda d, m: sorted(r.score for r in toxicity.toxicity(d, m).collect())
    assert score(docs, model) == score(docs, again)
    assert score(docs, model) == score(docs.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("x"), "doc_id": F.col("doc_id") + 10_000}), model)


def test_long_texts_in_parts(monkeypatch, learned):
    model = learned[3]
    texts = [" ".join(f"en{i % 50} de{i % 7}, get" for i in range(90)) + tail for tail in ("", " lost", "! lost and found", " " * 200 + "vile" + "x" * 300)]
    whole = toxicity._chances(model, pa.array(texts))
    for piece in (40, 97, 1000):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        np.testing.assert_allclose([toxicity._chances(model, pa.array([t]))[0] for t in texts], whole, atol=1e-6)


def test_edges(spark, learned):
    model = learned[3]
    long = "word " * 300_000
    docs = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "vile"), (3, "..."), (4, long), (-5, "vile")], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("score", "key", "label", "words", "predicted")})
    rows = toxicity.toxicity(docs, model).collect()
    by = {(r.doc_id, r.held_out): r.score for r in rows}
    assert len(rows) == 7 and by[1, zlib.crc32(b"1") % 5 == 0] == by[2, zlib.crc32(b"2") % 5 == 0] == by[3, zlib.crc32(b"3") % 5 == 0]
    assert by[None, False] > 0.5
    assert toxicity.toxicity(docs.where("false"), model).count() == 0
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (4, 0), (99, 1)], "doc_id long, toxic int")
    for told, docs_now in ((labels, docs), (labels.where("false"), docs), (labels, docs.where("false"))):
        model = toxicity.learn(docs_now, told)
        assert list(model) == ["prior"] and {r.score for r in toxicity.toxicity(docs, model).collect()} == {model["prior"]}
