"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyforge.llm import decontaminate, langid, lines, pieces, quality, registry, sharding, simhash, substring, topk, warc

LONG = " ".join(f"word{i % 977} and more" for i in range(60_000))
ROWS = [
    (1, "the one text with words and\nlines", "en", "s", 5),
    (1, "the one text with words and\nlines", "en", "s", 5),
    (2, None, "en", None, None),
    (3, "", None, "s", 0),
    (4, LONG, "en", "s", len(LONG)),
    (5, LONG + " end", "de", "s", 3),
    (None, "no id here at all", "en", "s", 1),
    (None, None, None, None, None),
    (6, "  \n\n\t ", "xx", "s", -4),
    (7, "the one text with words and\nlines", "de", "s", 5),
    (-8, "12 34 !!", "de", "s", 5),
]
#: Names that the operators use for their own columns.
CLASH = ["ids", "hub", "shard", "slot", "size", "print", "start", "end", "spans", "score", "lang_pred", "n_lines", "n_removed", "doc", "words", "anchor", "keep", "decoded", "label", "first", "lower", "component_id"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ITEMS = [(1, "the one text with words"), (2, None), (None, "x"), (3, ""), (1, "the one text with words"), (4, "word0 and more word1 and more")]
LABELS = [(1, 1, 0), (1, 0, 0), (None, 1, 1), (4, None, 0), (5, 0, None), (99, 1, 0)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({c: F.lit(c) for c in CLASH})


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("start", F.lit(0))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("label", F.lit(0))


def test_sharding(spark, docs, none):
    rows = sharding.assign_shards(docs, shards=4).collect()
    assert sorted(r.shard for r in rows) == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3]
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id in (2, 3)} == {(8, 0)}
    assert sharding.assign_shards(none, shards=4).count() == 0
    assert sharding.assign_shards(docs.limit(2), shards=9).agg(F.max("slot")).first()[0] == 0


def test_decontamination(docs, none, items):
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.leaks(docs, items).collect()}
    assert got == {(1, 1): 0, (7, 1): 0, (4, 4): 0, (5, 4): 0}
    assert decontaminate.leaks(none, items).count() == 0 and decontaminate.leaks(docs, items.where("false")).count() == 0


def test_language(docs, none):
    model = langid.learn(docs)
    rows = langid.identify(docs, model).collect()
    assert len(rows) == len(ROWS) and {r.lang_pred for r in rows if r.doc_id in (2, 3, 6, -8)} == {"und"}
    assert langid.label(docs, model).columns == [c for c in docs.columns if c not in ("lang_pred", "score", "spans")] + ["lang_pred", "score", "spans"]
    empty = langid.learn(none)
    assert {(r.lang_pred, r.score) for r in langid.identify(docs, empty).collect()} == {("und", 0.0)}
    assert langid.identify(none, model).count() == 0


def test_top_k(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (0, [0.5, 1.0]), (50, [0.1]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (None, [1.0, 1.0]), (7, [1.0, 0.5]), (8, [1.0, 0.5]), (-50, [-1.0, 2.0]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    got = topk.top_k(topk.quantised(df)).orderBy("query_id", "rank").collect()
    ids = {q: [r.vec_id for r in got if r.query_id == q] for q in (-50, 0, 50)}
    assert ids == {-50: [0, 7, 8, 9, 50], 0: [-50, 7, 8, 50, 9], 50: [7, 8, 0, 9, -50]}
    assert topk.top_k(topk.quantised(df.where("false"))).count() == 0 and topk.top_k(topk.quantised(df.where("vec_id = 7"))).count() == 0


def test_near_duplicates(docs, none):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert by[2] == by[3] == by[6] == {("0" * 16, 2)} and {c for _, c in by[7]} == {1}
    assert {c for _, c in by[5]} == {4} and simhash.near_duplicates(none).count() == 0


def test_lines(docs, none):
    out = lines.dedup_lines(docs)
    rows = out.collect()
    assert len(rows) == len(ROWS) and set(out.columns) == set(docs.columns)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[7].text == "" and by[7].n_removed == 2 and [r.text for r in rows if r.doc_id == 1] == [ROWS[0][1]] * 2
    assert by[2].text is None and by[2].n_lines == 0 and by[6].text == ROWS[8][1] and by[3].n_lines == 1
    assert {r.text for r in rows if r.doc_id is None} == {"no id here at all", None} and lines.dedup_lines(none).count() == 0


def test_pieces(docs, none):
    rows = pieces.decode(pieces.encode(docs)).collect()
    assert len(rows) == len(ROWS) and all(r.decoded == r.text for r in rows)
    assert all((r.ids is None) == (r.text is None) for r in rows) and [r.ids for r in rows if r.text == ""] == [[]]
    assert pieces.decode(pieces.encode(none)).count() == 0


def test_archives(spark, tmp_path):
    big = "y" * 3_000_000
    rows = [(1, None, big), (1, "u", big), (None, "u", big), (5, "u", big), (2, "u", None), (3, "", ""), (4, "u\r\nX: 1", "é")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("d")).withColumn("n", F.lit(0)).withColumn("latest", F.lit(9))
    out = warc.archived(warc.read_archives(warc.write_archives(pages, f"file://{tmp_path}/a"))).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_bytes) for r in out) == [
        (0, "response", 0, 3_000_000), (1, "revisit", 5, 3_000_000), (1, "revisit", 5, 3_000_000), (2, "response", 0, 0), (3, "response", 0, 0), (4, "response", 0, 2), (5, "response", 0, 3_000_000),
    ]
    assert warc.archived(warc.read_archives(warc.write_archives(pages.where("false"), f"file://{tmp_path}/b"))).count() == 0


def test_substrings(docs, none):
    rows = substring.remove_repeated_spans(docs).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[2].n_words == by[3].n_words == by[6].n_words == 0 and by[2].kept == ""
    assert by[5].n_removed == 180_000 and by[5].kept == "end" and by[4].n_words == 180_000 and by[7].n_removed == 0
    assert by[4].n_removed == 180_000 - 977 * 3  # the text repeats itself after 977 words
    assert substring.remove_repeated_spans(none).count() == 0


def test_repeated_long_rows_keep_their_words(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    for most in (1, 1000):
        assert sorted((r.doc_id, r.n_removed) for r in substring.remove_repeated_spans(df, most=most).collect()) == [(1, 0), (1, 0), (2, 40)]


def test_quality(docs, none, labels):
    rows = quality.featured(docs, labels)
    got = quality.score(rows, quality.learn(rows)).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert quality.score(quality.featured(none), quality.learn(quality.featured(none, labels))).count() == 0
    assert {r.score for r in quality.score(rows, quality.learn(quality.featured(docs, labels.where("false")))).collect()} == {0.5}


def folder(tmp_path, docs, items):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_pipeline_stages(spark, docs, none, items, tmp_path):
    where = folder(tmp_path, docs.select("doc_id", "text", "lang", "source", "n_chars"), items)
    for df in (docs, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, where)
            assert name == "tokens" or out.columns == df.columns
            assert out.count() <= len(ROWS)
    assert {r.doc_id for r in corpus_pipeline.run(spark, where).collect()} <= {None, 1, 4, 5}
    assert "pipeline" not in registry.QUERIES and len(registry.QUERIES) == 13
