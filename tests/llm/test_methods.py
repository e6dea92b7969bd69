"""The corpus operators against brute force, SQL, the library and held-out rows."""

from __future__ import annotations

import gzip
import hashlib
import io
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from oracle import compare, connect
from tallyforge.llm import components, decontaminate, langid, lines, pieces, quality, sharding, simhash, substring, topk, warc
from tallyforge.llm.shared import discard, hash_spans, materialize, row_pieces, text_bytes, words_of


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def table(spark, texts, **more):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


# --------------------------------------------------------------------------- shared


def test_words_and_hashes():
    column = pa.array(["a bb a\n", "", None, "\x0b a\tbb", "é x", "long" * 200_000])
    body, at = text_bytes(column)
    s, e, rows = words_of(body, at)
    assert [bytes(body[a:b]) for a, b in zip(s[:7], e[:7])] == [b"a", b"bb", b"a", b"a", b"bb", "é".encode(), b"x"]
    assert rows.tolist() == [0, 3, 3, 3, 5, 7, 8]
    h = hash_spans(body, s, e)
    assert h[0] == h[2] == h[3] and h[1] == h[4] and len(set(h.tolist())) == 5
    assert sum(p.num_rows for p in row_pieces(pa.RecordBatch.from_arrays([column], ["t"]), "t", 10)) == 6


def test_materialized_tables_can_go(spark):
    df = materialize(spark.range(5), "five")
    assert df.count() == 5 and not any("Range" in x for x in df._jdf.queryExecution().toString().split())
    discard(df)


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7)]
    got = {x.node: x.component for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: root[x] for e in edges for x in e if e[0] != e[1]}


# --------------------------------------------------------------------------- sharding


def check_shards(rows, shards):
    by = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(shards)}
    sizes = [len(x) for x in by.values()]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    assert all(x == list(range(len(x))) for x in by.values())


def test_shards_balance_and_keep_groups(spark, sf):
    rows = sharding.query(spark, sf).collect()
    check_shards(rows, 24)
    texts = [f"group {i % 150}" for i in range(400)] + [f"single {i}" for i in range(200)] + ["hot"] * 300
    rows = sharding.assign_shards(table(spark, texts), shards=6).collect()
    check_shards(rows, 6)
    where = {}
    for r in rows:
        where.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert sum(len(s) > 1 for t, s in where.items() if t != "hot") == 0
    assert len(where["hot"]) <= 3  # 300 rows in shards of 150
    assert {r.doc_id: r.text_crc32 for r in rows}[0] == 0xFFFFFFFF & __import__("zlib").crc32(b"group 0")


def test_shards_follow_general_links(spark):
    df = table(spark, [f"t{i}" for i in range(120)])
    links = spark.createDataFrame([(i, f"h{i // 6}") for i in range(120)] + [(i, f"g{i // 12}") for i in range(120)], "doc_id long, hub string")
    rows = sharding.assign_shards(df, shards=4, links=links).collect()
    check_shards(rows, 4)
    cut = sum(len({r.shard for r in rows if r.doc_id // 12 == g}) > 1 for g in range(10))
    assert cut <= 2  # ten groups of 12 in shards of 30: two groups have to be cut


def spread(where, links):
    """Members of hubs outside the shard that holds most of the hub."""
    by = {}
    for d, h in links:
        by.setdefault(h, []).append(where[d])
    return sum(len(x) - max(map(x.count, x)) for x in by.values())


def graph(seed, groups, size, hubs, of, across):
    """Hubs of ``of`` members within groups, and some of two members between groups; documents in random order."""
    r = random.Random(seed)
    links = [(g * size + d, f"h{g}-{h}") for g in range(groups) for h in range(hubs) for d in r.sample(range(size), of)]
    links += [(g * size + r.randrange(size), f"x{k}") for k in range(across) for g in r.sample(range(groups), 2)]
    r.shuffle(order := list(range(groups * size)))
    return [(order[d], h) for d, h in links], {order[d]: d // size for d in range(groups * size)}


def sharded(spark, links, n, shards):
    rows = sharding.assign_shards(table(spark, [f"t{i}" for i in range(n)]), shards=shards, links=spark.createDataFrame(links, "doc_id long, hub string")).collect()
    check_shards(rows, shards)
    return {x.doc_id: x.shard for x in rows}


def test_shards_of_a_small_graph_against_all_splits(spark):
    links, _ = graph(4, 2, 6, 7, 3, 1)
    cuts = sorted(spread({d: d in half for d in range(12)}, links) for half in itertools.combinations(range(12), 6))
    got = spread(sharded(spark, links, 12, 2), links)
    assert got <= cuts[len(cuts) // 100]  # among the best hundredth of the even splits


def test_shards_find_planted_groups(spark):
    links, group = graph(5, 3, 60, 80, 4, 8)
    got, planted = spread(sharded(spark, links, 180, 3), links), spread(group, links)
    r = random.Random(1)
    chance = spread({d: r.randrange(3) for d in group}, links)
    print(got, planted, chance)
    assert got - planted <= (chance - planted) / 3


def test_moves_keep_quotas():
    free = [0, 2, 0]
    moves = sharding.admitted_moves({(0, 1, 0): 2, (1, 0, 0): 3, (2, 0, 1): 1, (0, 2, 0): 1, (1, 2, 3): 5}, free)
    assert set(moves) == {(0, 1, 0), (2, 0, 1), (0, 2, 0)} or min(free) >= 0
    assert (1, 2, 3) not in moves and min(free) >= 0


# --------------------------------------------------------------------------- decontamination


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def words(t):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())


def brute_leaks(docs, items):
    out = {}
    for d, t in docs:
        w = words(t)
        for k, item in items:
            v = words(item)
            best = min(((edit(w[i : i + len(v)], v), i) for i in range(len(w) - len(v) + 1)), default=None) if v else None
            if best and best[0] <= decontaminate.edits_allowed(len(v)):
                out[d, k] = best
    return out


def test_leaks_against_brute_force(spark):
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(r.choice(vocab) for _ in range(n))) for k, n in enumerate((1, 3, 5, 8, 15, 22, 22, 30))]
    docs = []
    for i in range(60):
        w = [r.choice(vocab) for _ in range(r.randrange(50))]
        if i % 2:
            v = words(r.choice(items)[1])
            for _ in range(r.randrange(decontaminate.edits_allowed(len(v)) + 2)):
                p = r.randrange(len(v))
                v[p : p + r.randrange(2)] = [r.choice(vocab)] * r.randrange(2)
                v = v or ["w0"]
            w[len(w) // 2 : len(w) // 2] = v
        docs.append((i, ", ".join(x.title() if i % 3 else x for x in w)))
    out = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(x.doc_id, x.item_id): (x.distance, x.start) for x in out.collect()}
    want = brute_leaks(docs, items)
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want) and len(want) > 20
    assert sum(got[k] == want[k] for k in got) >= 0.98 * len(got)


def test_walks_agree_as_often_as_assumed():
    rng = np.random.default_rng(0)
    for n in (15, 59):
        x = rng.integers(1, 1 << 63, (100, n), dtype=np.uint64)
        y = x.copy()
        for row in y:
            row[rng.choice(n, decontaminate.edits_allowed(n), replace=False)] = rng.integers(1, 1 << 63, decontaminate.edits_allowed(n), dtype=np.uint64)
        a, b = (decontaminate.walk_keys(z, 200) for z in (x, y))
        assert (a == b).mean() >= decontaminate.AGREE * 0.9
    a, b = [rng.integers(0, 4, (40, 9)).astype(np.uint64) for _ in range(2)]
    assert decontaminate.edit_distances(a, b).tolist() == [edit(list(p), list(q)) for p, q in zip(a, b, strict=True)]


def test_leaks_in_driver_tables(spark, sf, docs):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    exact = {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if " " + " ".join(words(i.text)) + " " in " " + " ".join(words(d.text)) + " "}
    got = {(x.doc_id, x.item_id) for x in decontaminate.query(spark, sf).collect()}
    assert exact and exact <= got


# --------------------------------------------------------------------------- language


def test_viterbi_against_brute_force():
    r = np.random.default_rng(2)
    for _ in range(20):
        rows = np.cumsum([0, *r.integers(0, 7, 5)])
        s = r.integers(-50, 1, (rows[-1], 3))
        path = langid.viterbi(s, rows, 20, chunk=4)
        total = lambda p, a: sum(s[a + i, x] for i, x in enumerate(p)) - 20 * sum(x != y for x, y in itertools.pairwise(p))
        for a, b in itertools.pairwise(rows.tolist()):
            if b > a:
                assert total(path[a:b], a) == max(total(p, a) for p in itertools.product(range(3), repeat=b - a))


def test_language_of_held_out_documents(spark, sf, docs):
    rows = langid.query(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 20 and sum(r.lang == r.lang_pred for r in rows) / len(rows) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixed_text_gives_spans(spark, docs):
    model = langid.learn(docs)
    by = {r.lang: r.text for r in docs.where("n_chars > 300").dropDuplicates(["lang"]).collect()}
    first, second = by["en"][:300], by["de"][:300]
    row = langid.identify(table(spark, [first + " " + second, "Слово", "12 !", None]), model).orderBy("doc_id").collect()
    assert [s.lang for s in row[0].spans] == ["en", "de"] and abs(row[0].spans[1].start - 301) < 12
    assert row[1].lang_pred in model.languages and row[1].score == 0
    assert [(x.lang_pred, x.score) for x in row[2:]] == [("und", 0.0), ("und", 0.0)]


def test_scripts_narrow_languages(spark):
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("слово дело", "ru"), ("word deal", "en"), ("λόγος", "el")] * 3)], "doc_id long, text string, lang string")
    out = langid.identify(table(spark, ["ы", "zzz", "ω"]), langid.learn(df)).orderBy("doc_id").collect()
    assert [r.lang_pred for r in out] == ["ru", "en", "el"]


# --------------------------------------------------------------------------- top k


def test_letters_of_all_planes(spark):
    df = spark.createDataFrame([(0, "\U00030001\U00030002\U000313AF", "zh"), (1, "\U0001F600 12", "zh"), (2, "\u4e00\u4e01", "zh")], "doc_id long, text string, lang string")
    rows = {x.doc_id: x for x in langid.identify(df, langid.learn(df)).collect()}
    assert (rows[0].lang_pred, rows[0].score) == ("zh", 1.0) and rows[1].lang_pred == "und" and rows[2].lang_pred == "zh"


def test_viterbi_in_passes_of_little_memory(monkeypatch):
    r = np.random.default_rng(8)
    scores, rows = r.integers(-3000, 0, (900, 5)), np.r_[0, np.sort(r.integers(0, 900, 40)), 900]
    want = langid.viterbi(scores, rows)
    monkeypatch.setattr(langid, "PASS_BYTES", 20_000)
    assert (langid.viterbi(scores, rows) == want).all()


def test_top_k_of_too_large_components(spark):
    with pytest.raises(ValueError, match="a long cannot hold"):
        topk.top_k(topk.quantised(spark.createDataFrame([(0, [1e30]), (1, [2.0])], "vec_id long, embedding array<double>")))


def test_top_k_against_sql(spark, sf, con):
    compare(topk.query(spark, sf), con, topk.SQL)


def test_top_k_in_many_blocks_with_ties(spark):
    r = random.Random(1)
    rows = [(i, [r.choice([-3, 0, 2]) for _ in range(4)]) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    got = [tuple(x) for x in topk.top_k(df, every=50, k=5, rows_a_block=40, queries_a_block=2).orderBy("query_id", "rank").collect()]
    want = []
    for q, v in rows[::50]:
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)[:5]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert got == want


def test_slices_add_up():
    r = np.random.default_rng(3)
    x = r.integers(-200, 300, (100, 6))
    block = topk.SlicedBlock(x)
    for q in r.integers(-150, 150, (5, 6)):
        terms = block.terms(q.tolist())
        sums = block.sums(terms)
        bits = np.array([np.unpackbits(s.view(np.uint8), bitorder="little")[:100] for s in sums])
        value = (bits.T.astype(object) * [1 << i for i in range(len(sums))]).sum(axis=1)
        low = x.min(axis=0)
        shift = sum(int(c) * int(m) - (abs(int(c)) * ((1 << b) - 1) if c < 0 else 0) for c, m, b in zip(q, low, block.bits, strict=True))
        assert (value + shift == x @ q).all()


# --------------------------------------------------------------------------- near duplicates


def plain_fingerprint(t):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
    hs = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in ([w[i : i + 3] for i in range(len(w) - 2)] or ([w] if w else []))]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs))


def test_fingerprints(docs):
    for r in docs.limit(40).collect():
        assert simhash.fingerprint(r.text.encode()) == plain_fingerprint(r.text)
    assert simhash.fingerprint(b"") == 0 and simhash.fingerprint(b"One") == plain_fingerprint("one")


def brute_classes(prints):
    root = {p: p for p in prints}
    for _ in prints:
        for a, b in itertools.combinations(prints, 2):
            if (a ^ b).bit_count() <= 2:
                root[a] = root[b] = min(root[a], root[b])
    return root


@pytest.mark.parametrize("tallied", [256, 3])
def test_near_fingerprints_are_linked(spark, tallied):
    r = random.Random(6)
    prints = {r.getrandbits(64) for _ in range(12)}
    for p in list(prints)[:6]:
        q = p
        for _ in range(6):
            for b in r.sample(range(64), r.choice([1, 2, 3])):
                q ^= 1 << b
            prints.add(q)
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    df = spark.createDataFrame([(p,) for p in prints], "print long")
    member = {x.node: x.component for x in components.connected_components(simhash.print_links(df, tallied)).collect()}
    want = brute_classes([p & (1 << 64) - 1 for p in prints])
    groups = lambda f: {frozenset(q for q in prints if f(q) == f(p)) for p in prints}
    assert groups(lambda p: member.get(p, p)) == groups(lambda p: want[p & (1 << 64) - 1])


def test_long_posting_lists_find_the_same_links():
    rng = np.random.default_rng(9)
    mask = simhash.MASKS[0]
    free = [i for i in range(64) if not mask >> i & 1]
    prints = np.unique(np.array([sum(1 << free[int(b)] for b in rng.choice(8, rng.integers(0, 4), replace=False)) for _ in range(300)], np.uint64))
    extra = np.unique(np.r_[prints, rng.integers(0, 1 << 30, 600).astype(np.uint64)])
    for p in (prints, extra):
        a, b = simhash.list_links(p)
        root = {int(x): int(x) for x in p}
        for x, y in zip(a.tolist(), b.tolist()):
            root[x] = y
        want = brute_classes(p.tolist()) if len(p) < 200 else None
        if want:
            assert {frozenset(k for k in root if root[k] == v) for v in root.values()} == {frozenset(k for k in want if want[k] == v) for v in want.values()}


def test_near_duplicate_classes(spark, sf, docs):
    rows = {r.doc_id: r for r in simhash.query(spark, sf).collect()}
    prints = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    root = brute_classes(sorted(set(prints.values())))
    first = {}
    for d, p in sorted(prints.items()):
        first.setdefault(root[p], d)
    assert {d: (r.fingerprint, r.component_id) for d, r in rows.items()} == {d: (f"{p:016x}", first[root[p]]) for d, p in prints.items()}


# --------------------------------------------------------------------------- lines


def test_patience():
    a, b = [1, 2, 3, 9, 4, 5], [1, 2, 8, 3, 4, 7, 5]
    assert lines.patience(a, b) == [(0, 0), (1, 1), (2, 3), (4, 4), (5, 6)]
    assert lines.patience([5, 6], [6, 5]) in ([(0, 1)], [(1, 0)]) and lines.patience([], [1]) == []
    r = random.Random(0)
    for _ in range(50):
        a, b = ([r.randrange(1, 12) for _ in range(r.randrange(12))] for _ in range(2))
        got = lines.patience(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(got))


def test_lines_leave_the_later_document(spark):
    body = [f"line {i} of the text" for i in range(8)]
    texts = ["\n".join(body), "\n".join(["new start", *body[2:6], "", "own end"]), "\n".join(["x", "y", "z"]), "\n".join(["common"] * 2 + ["q"])]
    texts += [f"common\nonly {i}\nmore {i}\nrest {i}" for i in range(60)] + ["\n".join(body[:4] + [f"tail {i}"]) for i in range(70)]
    out = {r.doc_id: r for r in lines.dedup_lines(table(spark, texts)).collect()}
    assert out[0].text == texts[0] and out[1].text == "new start\n\nown end" and (out[1].n_lines, out[1].n_removed) == (7, 4)
    assert all(out[i].text == texts[i] for i in range(2, 64))  # a frequent line alone is no overlap
    assert all(out[64 + i].text == f"tail {i}" for i in range(70))  # copies of frequent lines are


def line_anchors(x, rare=lines.RARE, many=lines.MANY, long=lines.LONG):
    """Runs of non-blank lines that may be anchors, with whether they always are."""
    full = [y for y in x if y.strip(" ")]
    n = lambda y: len(re.findall(r"\S+", y))
    out = {(y,): n(y) >= long for y in full}
    out |= {(y, z): True for y, z in itertools.pairwise(full) if n(y) < long and n(z) < long and n(y) + n(z) >= long}
    return out | {tuple(full[i : i + many]): True for i in range(len(full) - many + 1)}


def brute_lines(rows, rare=lines.RARE, nearest=True):
    """Lines that align with an earlier document that shares an anchor: the nearest one of each anchor, or every one."""
    split = {d: (t or "").split("\n") for d, t in rows}
    mine = {d: line_anchors(x) for d, x in split.items()}
    holders = {}
    for d in sorted(split):
        for run in mine[d]:
            holders.setdefault(run, []).append(d)
    out = {}
    for d, x in split.items():
        few = sum(bool(y.strip(" ")) for y in x) <= lines.FEW
        pairs = {}
        for run, always in mine[d].items():
            before = [e for e in holders[run] if e < d]
            if before and (always or few or len(holders[run]) <= rare):
                for e in before[-1:] if nearest else before:
                    pairs.setdefault(e, set()).add(run)
        at = [i for i, y in enumerate(x) if y.strip(" ")]
        gone = set()
        for e, runs in pairs.items():
            other = [y for y in split[e] if y.strip(" ")]
            code = {y: i for i, y in enumerate(dict.fromkeys([x[i] for i in at] + other), 1)}
            gone |= {at[p] for p, _ in lines.patience([code[x[i]] for i in at], [code[y] for y in other])}
            for run in runs:
                gone |= {at[i + j] for i in range(len(at)) for j in range(len(run)) if tuple(x[k] for k in at[i : i + len(run)]) == run}
        out[d] = "\n".join(y for i, y in enumerate(x) if i not in gone)
    return out


def removed_share(rows, out):
    return {d: len((t or "").split("\n")) - (len(out[d].split("\n")) if out[d] else 0) for d, t in rows}


def test_lines_against_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}
    assert got == brute_lines(rows)
    every = brute_lines(rows, nearest=False)  # against all earlier documents, not the nearest of each anchor
    lost = sum(abs(a - b) for a, b in zip(removed_share(rows, got).values(), removed_share(rows, every).values(), strict=True))
    assert lost <= 0.01 * sum(removed_share(rows, every).values())


def test_blocks_of_many_documents_leave_all_but_the_first(spark):
    """A block of five short lines that five other documents had first, line by line, in more documents than rare ones."""
    block = [f"short line {i}" for i in range(5)]
    texts = [f"own {i} a\nown {i} b\n{y}\nown {i} c" for i, y in enumerate(block)]
    texts += ["\n".join([f"head {k}", *block, f"tail {k} x", f"tail {k} y"]) for k in range(60)]
    rows = lines.dedup_lines(table(spark, texts)).orderBy("doc_id").collect()
    assert sum(r.n_removed for r in rows) == 59 * 5 and rows[5].n_removed == 0


def test_blocks_in_another_order_and_twice(spark):
    p, q = " ".join(f"p{i}" for i in range(30)), " ".join(f"q{i}" for i in range(30))
    texts = [f"{q}\nx\n{p}", f"{p}\ny\n{q}", f"{p}\nz\n{q}\nw\n{p}"]
    assert [r.text for r in lines.dedup_lines(table(spark, texts)).orderBy("doc_id").collect()] == [texts[0], "y", "z\nw"]


# --------------------------------------------------------------------------- pieces


def test_ids_equal_the_library(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [r.text for r in docs.collect()] + ["", " ", "  lead", "a  b   c ", "x\n\ny\t z", "ﬁ é 日本語 🎉🎉", "<s> </s> <0x41>", "▁a ▁", "of\r\nthe", "a" * 3000, "aaaa " * 50, "?!?!--==", "\x00\x01"]
    rows = pieces.decode(pieces.encode(table(spark, texts))).orderBy("doc_id").collect()
    assert [r.ids for r in rows] == [library.encode(t) for t in texts]
    assert all(r.decoded == t.replace("▁", " ") for r, t in zip(rows, texts, strict=True))
    assert pieces.round_trip(table(spark, texts)).orderBy("doc_id").collect() == rows


def test_models_of_another_kind_are_refused():
    def message(*fields):
        return b"".join(bytes([n << 3 | (0 if isinstance(v, int) else 2)]) + (bytes([v]) if isinstance(v, int) else bytes([len(v)]) + v) for n, v in fields)

    bpe, unigram, keeps = message((3, 2)), message((3, 1)), message((4, 0))
    pieces.check_model(message((2, bpe), (3, keeps)), True)
    pieces.check_model(message((2, unigram), (3, keeps)), False)
    for model, merges in ((message((2, unigram), (3, keeps)), True), (message((2, bpe), (3, keeps)), False), (message((2, bpe)), True), (message((2, bpe), (3, message((2, b"map"), (4, 0)))), True)):
        with pytest.raises(ValueError):
            pieces.check_model(model, merges)


def test_unigram_viterbi_shares_prefixes():
    p = pieces.Pieces.__new__(pieces.Pieces)
    r = random.Random(5)
    alphabet = "abc"
    vocabulary = sorted({"".join(r.choices(alphabet, k=r.randrange(1, 4))) for _ in range(14)} | set(alphabet))
    p.merges, p.piece, p.score = False, vocabulary, [-r.random() * 5 for _ in vocabulary]
    p.id = p.whole = {x: i for i, x in enumerate(vocabulary)}
    p.tails, p.follows, p.byte, p.unknown = pieces.tails_of(p.whole), {}, {}, 0
    for text in sorted("".join(r.choices(alphabet, k=r.randrange(1, 8))) for _ in range(40)):
        def best(t):
            if not t:
                return 0.0
            return max(p.score[p.id[t[:n]]] + best(t[n:]) for n in range(1, 4) if t[:n] in p.id and n <= len(t))
        got = p.encode_sorted([text])[0]
        assert "".join(vocabulary[i] for i in got) == text and math.isclose(sum(p.score[i] for i in got), best(text))
    many = sorted({"".join(r.choices(alphabet, k=r.randrange(1, 8))) for _ in range(60)})
    assert p.encode_sorted(many) == [p.encode_sorted([w])[0] for w in many]


# --------------------------------------------------------------------------- archives


def test_archives_against_sql(spark, sf, con):
    compare(warc.query(spark, sf), con, warc.SQL)


def test_archives_round_trip(spark, tmp_path):
    body = "<p>é\r\n\r\nWARC/1.1\r\n" + "x" * 200_000
    rows = [(1, "http://a/b c", body), (2, None, body), (3, "u", ""), (4, "u", None), (5, "http://z", "small"), (6, "http://z", "small"), (7, "q", body)]
    manifest = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/w", file_bytes=1)
    chunks = warc.read_archives(manifest)
    got = {}
    for r in sorted(chunks.collect(), key=lambda r: (r.page_id, r.chunk)):
        got.setdefault(r.page_id, bytearray()).extend(r.data)
    assert bytes(got[7]) == body.encode() and bytes(got[1]) == b"" and bytes(got[5]) == b"small"
    last = {r.page_id: r for r in warc.archived(chunks).collect()}
    assert [last[i].record_type for i in range(1, 8)] == ["revisit", "revisit", "response", "response", "response", "response", "response"]
    assert last[1].refers_to == 7 and last[1].payload_bytes == len(body.encode()) and last[2].payload_digest == hashlib.sha1(body.encode()).hexdigest()
    parts = [r for r in chunks.where("page_id = 7").orderBy("chunk").collect()]
    assert len(parts) == -(-len(body.encode()) // warc.CHUNK) and [p.last for p in parts] == [False] * (len(parts) - 1) + [True]
    assert parts[0].digest == hashlib.sha1(body.encode()[: warc.CHUNK]).hexdigest()
    text = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.warc.gz"))
    assert text.count(b"WARC-Type: response\r\n") == 5 and text.count(b"WARC-Refers-To: <urn:uuid:") == 2
    assert not list((tmp_path / "w").glob(".part*"))


def test_plain_archives_of_other_tools():
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\nhello"
    head = lambda kind, size, more="": f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{kind}>\r\nContent-Type: application/http\r\nContent-Length: {size}\r\n{more}\r\n".encode()
    raw = head("response", len(body)) + body + b"\r\n\r\n" + head("revisit", len(body) - 5, "WARC-Refers-To: <response>\r\n") + body[:-5] + b"\r\n\r\n"
    rows = list(warc.record_chunks(io.BytesIO(raw)))
    assert [(x[0], x[1], x[2], x[3], x[7]) for x in rows] == [("<response>", "response", None, None, b"hello"), ("<revisit>", "revisit", None, "<response>", b"")]


def test_damaged_archives_are_told():
    whole = gzip.compress(warc.record_head(1, "u", hashlib.sha1(b"abc").hexdigest(), 3, None, "d") + b"abc\r\n\r\n")
    assert [r[7] for r in warc.record_chunks(io.BytesIO(whole))] == [b"abc"]
    with pytest.raises(ValueError):
        list(warc.record_chunks(io.BytesIO(gzip.compress(b"no record\r\n"))))
    with pytest.raises(ValueError):
        list(warc.record_chunks(io.BytesIO(whole[:-30])))


# --------------------------------------------------------------------------- substrings


def brute_spans(rows, window=20):
    seen, out = set(), {}
    for d, t in sorted(rows):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone[i : i + window] = [True] * window
            seen.add(k)
        out[d] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


def kept(df):
    return {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in df.collect()}


@pytest.mark.parametrize("most", [substring.MOST, 1])
def test_substrings_against_brute_force(spark, docs, most):
    assert kept(substring.remove_repeated_spans(docs, most=most)) == brute_spans([(r.doc_id, r.text) for r in docs.collect()])
    r = random.Random(7)
    texts = [" ".join(r.choice("ab") for _ in range(r.randrange(60))) for _ in range(40)]
    assert kept(substring.remove_repeated_spans(table(spark, texts), window=5, most=most)) == brute_spans(list(enumerate(texts)), 5)


@pytest.mark.parametrize("most", [substring.MOST, 30, 3])
def test_substrings_of_shards_cut_again(spark, most):
    r = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    passage = r.sample(words, 34)
    texts = []
    for _ in range(240):  # passages of every length from 6 words on, at every place, in text of their own
        a, n = r.randrange(20), r.randrange(6, 30)
        texts.append(" ".join([*r.choices(words, k=r.randrange(30)), *passage[a : a + n], *r.choices(words, k=r.randrange(30)), *passage[:8], *r.choices(words, k=20)]))
    assert kept(substring.remove_repeated_spans(table(spark, texts), most=most)) == brute_spans(list(enumerate(texts)))


def test_substrings_of_a_repeated_row(spark):
    texts = ["a b c d e f g h", "a b c d e x y z", "q a b c d e f w"]
    want = brute_spans(list(enumerate(texts)), 5)
    rows = [(i, t) for i, t in enumerate(texts) for _ in range(3)]
    for most in (substring.MOST, 1):
        got = substring.remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), window=5, most=most)
        assert got.count() == 9 and kept(got) == want
    r = random.Random(3)
    texts = [" ".join(r.choices("abc", k=30)) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(texts) for _ in range(2)]
    for most in (substring.MOST, 1):
        got = substring.remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), window=8, most=most)
        assert kept(got) == brute_spans(list(enumerate(texts)), 8)


def test_matching_statistics():
    r = random.Random(2)
    for _ in range(20):
        strings = [[r.randrange(3) for _ in range(r.randrange(12))] for _ in range(4)]
        a = substring.SuffixAutomaton()
        for s in strings:
            a.add(s)
        known = {tuple(s[i:j]) for s in strings for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        q = [r.randrange(3) for _ in range(15)]
        want = [max((n for n in range(1, e + 1) if tuple(q[e - n : e]) in known), default=0) for e in range(1, 16)]
        assert a.matching(q) == want


# --------------------------------------------------------------------------- quality


def test_quality_of_labelled_documents(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.query(spark, sf).join(labels, "doc_id").collect()
    assert sum((r.score >= 0.5) == (r.quality == 1) for r in rows) / len(rows) >= 0.95
    assert quality.query(spark, sf).count() == docs.count()


def plain_sums(views, label, apart):
    """Sums and calibration over arrays in two parts, as the tasks of two partitions have them."""
    at = np.array_split(np.arange(len(label)), 2)
    total = lambda f: sum(f(([x[i] for x in views], label[i], apart[i])).astype(float) for i in at)
    held = apart & (label >= 0)
    return total, lambda weights: (np.stack([quality.odds(x[held], w) for x, w in zip(views, weights)], 1), label[held])


def plain_co_train(views, label, apart, rounds):
    """Co-training step by step on whole arrays, with fits of its own."""
    known, pool, prior = label >= 0, (label < 0).sum(), label[label >= 0].mean()
    told, weights = [np.where(known, label, -1) for _ in views], [np.zeros(x.shape[1] + 1) for x in views]
    for r in range(rounds + 1):
        for v, x in enumerate(views):
            use = (told[v] >= 0) & ~(known & apart)
            full = np.c_[x[use], np.ones(use.sum())]
            ridge = np.r_[np.ones(x.shape[1]), 1e-6]
            for _ in range(quality.MORE_STEPS if r else quality.FIRST_STEPS):
                p = 1 / (1 + np.exp(-full @ weights[v]))
                weights[v] = weights[v] - np.linalg.solve((full.T * (p * (1 - p))) @ full + np.diag(ridge), full.T @ (p - told[v][use]) + ridge * weights[v])
        if r < rounds:
            new = [t.copy() for t in told]
            for v, x in enumerate(views):
                z = np.clip(x @ weights[v][:-1] + weights[v][-1], -30, 30)
                free = told[1 - v] < 0
                for value, sure in ((0, -z), (1, z)):
                    most, grid = quality.GROWTH * pool * (prior if value else 1 - prior), np.arange(-30, 30, 60 / quality.ODDS_BINS)
                    least = next((g for g in grid if g >= np.log(9) and (free & (sure >= g)).sum() <= most), np.inf)
                    new[1 - v][free & (sure >= least)] = value
            told = new
    return weights, told


def test_co_training_against_plain_numpy():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 4000)
    views = [y[:, None] * 2.0 + rng.normal(0, 1, (4000, 2)), np.c_[y * 2.0 + rng.normal(0, 1, 4000), rng.normal(0, 1, (4000, 6))]]
    label, apart = np.where(np.arange(4000) < 300, y, -1), np.arange(4000) % 5 == 0
    model = quality.co_train(*plain_sums(views, label, apart), [2, 7], rounds=3)
    weights, told = plain_co_train(views, label, apart, 3)
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(model["weights"], weights)) and sum((t >= 0).sum() for t in told) > 1000


def test_scores_of_held_out_labels(spark, docs):
    """Rows of sf0.01 whose labels were never seen, ranked by score."""
    where = "/root/testdata/sf0.01"
    labels, away = spark.read.parquet(f"{where}/labels.parquet"), F.pmod(F.xxhash64(F.lit("away"), "doc_id"), F.lit(3)) == 0
    rows = quality.featured(spark.read.parquet(f"{where}/documents.parquet"), labels.where(~away))
    got = quality.score(rows, quality.learn(rows)).join(labels.where(away), "doc_id").collect()
    good, bad = ([r.score for r in got if r.quality == q] for q in (1, 0))
    assert len(bad) > 5 and sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad)) >= 0.95


def test_co_training_uses_the_other_view():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 3000)
    views = [y[:, None] * 2.0 + rng.normal(0, 1, (3000, 1)), np.c_[y * 2.0 + rng.normal(0, 1, 3000), rng.normal(0, 1, (3000, 20))]]
    told = np.where(np.arange(3000) < 60, y, -1)
    apart = np.arange(3000) % 3 == 0
    model = quality.co_train(*plain_sums(views, told, apart), [1, 21])
    alone = quality.co_train(*plain_sums(views, told, apart), [1, 21], rounds=0)
    right = lambda m, v: ((quality.odds(views[v], np.array(m["weights"][v])) > 0) == (y == 1))[60:].mean()
    assert right(model, 1) >= right(alone, 1) and right(model, 0) > 0.8
    assert "weights" not in quality.co_train(*plain_sums(views, np.where(told == 1, 1, -1), apart), [1, 21])
