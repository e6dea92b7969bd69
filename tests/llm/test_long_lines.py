"""Passages of one or two long lines in many documents."""

from __future__ import annotations

from tallyforge.llm import lines


def texts_with(passage, n=70):
    return [(i, "\n".join([f"own {i}", f"more {i}", f"text {i}", passage, *(f"end {i} {k}" for k in range(6))])) for i in range(n)]


def test_a_long_line_of_many_documents_goes(spark):
    for passage, size in ((" ".join(f"word{k}" for k in range(60)), 1), (" ".join(f"one{k}" for k in range(12)) + "\n" + " ".join(f"two{k}" for k in range(12)), 2)):
        rows = texts_with(passage)
        got = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got[0].text == rows[0][1] and got[0].n_removed == 0
        assert all(got[i].n_removed == size and got[i].text == rows[i][1].replace(passage + "\n", "") for i in range(1, 70))


def test_a_short_line_of_many_documents_stays(spark):
    rows = texts_with(" " * 40 + "a frequent line of seven words alone")
    got = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].text == t for i, t in rows)


def test_one_copy_stays_however_many_hold_it(spark):
    """A block of five short lines in 2,500 documents, and 3,000 equal documents of one line: the first keeps it, alone."""
    block = "\n".join(f"short line {k}" for k in range(5))
    rows = [(i, f"own {i}\n{block}\nend {i}") for i in range(2500)] + [(i, "one line alone") for i in range(5000, 8000)]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "7")  # more ranges than anchors
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.doc_id: r.n_removed for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(9)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert [i for i, n in got.items() if not n and i < 2500] == [0] and [i for i, n in got.items() if not n and i >= 5000] == [5000]
    assert {n for i, n in got.items() if 0 < i < 2500} == {5} and {n for i, n in got.items() if i > 5000} == {1}


def test_samples_of_any_number_of_rows():
    """About as many rows as asked for are taken of ten, a thousand million and 10^13."""
    from tallyforge.llm.shared import last_ticket

    for n in (10, 2000, 10**9, 10**10, 10**13):
        assert abs((last_ticket(2000, n) + 1) / 2**63 * n - min(n, 2000)) < 1
    assert last_ticket(2000, 0) == 2**63 - 1
