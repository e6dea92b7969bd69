"""The pipeline against plain Python, stage by stage on what the stage before kept."""

from __future__ import annotations

import sentencepiece
from test_methods import brute_leaks, brute_lines
from test_similar import classes

import corpus_pipeline
from tallyforge.llm import langid, pieces


def test_pipeline_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    seen = {r.doc_id: r for r in langid.identify(docs, langid.learn(docs)).collect()}
    rows = {r.doc_id: r.text for r in docs.collect() if seen[r.doc_id].lang_pred != "und" and seen[r.doc_id].score >= 0.5}
    cut = brute_lines(sorted(rows.items()))
    rows = {d: cut[d] for d, t in rows.items() if cut[d] == t or cut[d].strip()}
    ids = sorted(rows)
    rows = {ids[i]: rows[ids[i]] for i in set(classes([rows[d] for d in ids]))}
    leaked = {d for d, _ in brute_leaks_fast(rows, items)}
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    want = {d: library.encode(t) for d, t in rows.items() if d not in leaked}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert {d: r.ids for d, r in got.items()} == want
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got.values())


def brute_leaks_fast(rows, items):
    """Brute force on the documents that share at least four words in a row with an item; no other can be near one."""
    from test_methods import words

    runs = {tuple(w[i : i + 4]) for _, t in items for w in [words(t)] for i in range(len(w) - 3)}
    near = [(d, t) for d, t in rows.items() for w in [words(t)] if any(tuple(w[i : i + 4]) in runs for i in range(len(w) - 3))]
    out = {}
    for d, t in near:
        w = words(t)
        for k, item in items:
            v = words(item)
            mine = {tuple(v[i : i + 4]) for i in range(len(v) - 3)}
            hits = [i for i in range(len(w) - 3) if tuple(w[i : i + 4]) in mine]
            for h in hits:
                lo, hi = max(0, h - len(v)), min(len(w), h + 2 * len(v))
                out |= {(d, i): x for (_, i), x in brute_leaks([(d, " ".join(w[lo:hi]))], [(k, item)]).items()}
                if (d, k) in out:
                    break
    return out
