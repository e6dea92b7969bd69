"""Near copies of the pipeline's stage against exact similarities."""

from __future__ import annotations

import itertools
import random

import corpus_pipeline
from tallyforge.llm import simhash, similar


def shingle_set(text):
    w = text.lower().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def planted():
    """Texts of 200 words, each with copies of which a few words are changed, one after the other and far apart."""
    r, out = random.Random(12), []
    for _ in range(60):
        base = [f"w{r.randrange(3000)}" for _ in range(200)]
        out.append(" ".join(base))
        for changes in (1, 2, 3, 4, 9):
            w = list(base)
            for i in r.sample(range(0, 200, 10), changes):
                w[i] = f"v{r.randrange(3000)}"
            out.append(" ".join(w))
    return out


def classes(texts):
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b]) if root[a] != root[b] else 0
        if both and both >= 0.8 * len(sets[a] | sets[b]):
            low, high = sorted((root[a], root[b]))
            root = [low if x == high else x for x in root]
    return root


def test_stage_drops_planted_near_copies(spark):
    texts = planted() + ["one two", "One  TWO", "one three"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = classes(texts)
    got = {r.doc_id: r.component_id for r in similar.near_copies(df).collect()}
    assert got == dict(enumerate(want))
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()}
    assert kept == set(want)
    far = [(simhash.fingerprint(texts[i].encode()) ^ simhash.fingerprint(texts[j].encode())).bit_count() for i, j in enumerate(want) if i != j]
    assert sum(x > 2 for x in far) > len(far) / 2  # what two bits lose


def test_similar_to_a_copy_only(spark):
    """Every copy is near the one before it; the star's centre is near few of them."""
    r = random.Random(3)
    w = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(12):
        texts.append(" ".join(w))
        for p in r.sample(range(300), 4):
            w[p] = f"c{i}-{p}"
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.component_id for r in similar.near_copies(df).collect()} == {0} == set(classes(texts))


def test_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, " \n"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in similar.near_copies(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}
    assert similar.near_copies(df.where("false")).count() == 0


def test_texts_of_one_doc_id_are_documents_of_their_own(spark):
    df = spark.createDataFrame([(7, "a b c d e f g"), (7, "q r s t u v w"), (7, "q r s t u v w"), (9, "A b c d e f g")], "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, df, "").collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(7, "a b c d e f g"), (7, "q r s t u v w")]


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    """A group without a centre near all of it, compared in blocks of three documents."""
    monkeypatch.setattr(similar, "BLOCK_DOCS", 3)
    r, texts = random.Random(5), []
    base = [f"w{i}" for i in range(200)]
    for _ in range(60):
        w = list(base)
        for i in r.sample(range(0, 200, 5), 6):
            w[i] = f"v{r.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [" ".join(base[:100] + [f"z{i}" for i in range(100)]), " ".join(base[:150])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in similar.near_copies(df).collect()}
    assert got == dict(enumerate(classes(texts)))
