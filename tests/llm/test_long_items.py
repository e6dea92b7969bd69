"""Edited leaks of items far longer than those of the test benchmark."""

from __future__ import annotations

import numpy as np
import pytest

from tallyforge.llm import decontaminate


@pytest.mark.parametrize("n", [60, 120, 200, 500])
@pytest.mark.parametrize("kind", ["substitute", "shift"])
def test_edited_copies_of_long_items_meet(n, kind):
    rng = np.random.default_rng([n, len(kind)])
    items = rng.integers(1, 1 << 63, (400, n), dtype=np.uint64)
    copies = decontaminate.edited(items, decontaminate.edits_allowed(n), kind, rng)
    a, b = (decontaminate.walk_keys(x, *decontaminate.plan(n)) for x in (items, copies))
    assert (a == b).any(axis=0).mean() >= 0.997


def test_search_finds_long_edited_leaks(spark):
    rng = np.random.default_rng(5)
    items, docs = [], []
    for k in range(40):
        w = rng.integers(0, 5000, 200)
        items.append((k, " ".join(f"w{x}" for x in w)))
        w[rng.choice(200, 40, replace=False)] = rng.integers(5000, 9000, 40)
        docs.append((k, " ".join(f"w{x}" for x in [*rng.integers(0, 5000, 30), *w, *rng.integers(0, 5000, 30)])))
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.start, r.words, r.distance) for r in found} == {(k, k, 30, 200, 40) for k in range(40)}
