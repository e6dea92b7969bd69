"""Hand-computed results and properties of operators that SQL does not express, and edge cases of those it does."""

from __future__ import annotations

import itertools
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import geometry, hamming, money, text
from tallyforge.functions.predicates import Predicates, java_regex, split_match
from tallyforge.operators import contest, entity, multiset, pairing, rank, rules, upsert
from tallyforge.sources import catalog, listing
from tallyforge.functions import quality
from tallyforge.streaming.segments import Segmenter, _streamed_step, contiguous_prefix, folded, ingested_once, segments, segments_streamed


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_prices(spark):
    f = lambda finish, *p: one(spark, money.priced(F.lit(finish), *[F.lit(x).cast("string") for x in p]))
    assert f("foil", "1", "2", None) == 2 and f("foil", "1", None, None) == 1 and f("nonfoil", None, "2", None) == 2
    assert f("etched", " ", "x", "3") == 3 and f("nonfoil", "n/a", "", None) is None
    assert one(spark, money.export_price(F.lit("nonfoil"), F.lit(None).cast("string"), F.lit("2"), F.lit("3"))) is None


def test_text_functions(spark):
    assert one(spark, text.name_norm(F.lit("Ação, do  Rei!"))) == "acao do rei"
    assert one(spark, text.name_norm_exact(F.lit("Ação ﬁm １"))) == "acao fim 1"
    assert [one(spark, text.collector_number(F.lit(x))) for x in ("007/250", "0012a", "000", "T-5")] == ["7", "12a", "0", "T-5"]
    assert one(spark, text.word_number(F.lit("Nine"))) == 9 and one(spark, text.word_number(F.lit("many"))) is None
    assert one(spark, text.type_group(F.lit("Artifact Land"))) == "Land" and one(spark, text.type_group(F.lit("Odd"))) == "Other"
    assert one(spark, text.money_text(F.lit(1234.5))) == "R$ 1.234,50"
    assert one(spark, text.remapped(F.lit("abc"), {"abc": "X"})) == "X" and one(spark, text.remapped(F.lit("q"), {})) == "Q"
    assert one(spark, text.display_name(F.lit("pt"), F.lit("normal"), F.lit("A // B"), F.lit("A"), F.lit("Á"))) == "Á"
    day = lambda d: one(spark, text.relative_day(F.to_date(F.lit(d)), F.to_date(F.lit("2024-05-10"))))
    assert [day(d) for d in ("2024-05-10", "2024-05-09", "2024-05-07", "2024-04-01")] == ["today", "yesterday", "3 days ago", "01/04/2024"]


def test_predicates(spark):
    df = spark.createDataFrame([("Elf", ["Green", "Red"], {"a": "1"}, 3.0, None), ("", [], {}, None, "x")], "name string, colors array<string>, m map<string,string>, cmc double, n string")
    p = Predicates(df)
    get = lambda rule: [r[0] for r in df.select(p.compile(rule)).collect()]
    assert get({"name_contains": "EL"}) == [True, False] and get({"colors_contains": "green"}) == [True, False]
    assert get({"colors_includes": "green"}) == [False, False] and get({"m.a_equals": "1"}) == [True, False]
    assert get({"name_truthy": True}) == [True, False] and get({"n_truthy": False}) == [True, False] and get({"cmc_gte": 3}) == [True, False]
    assert get({"missing_equals": 1}) == [False, False] and get({"missing_truthy": False}) == [True, True]
    assert get({}) == [False, False] and get(None) == [False, False] and get({"always": True}) == [True, True]
    assert get({"not": {"cmc_lte": 2}}) == [True, True] and get({"any": []}) == [False, False] and get({"all": []}) == [True, True]
    assert split_match("type_line_contains") == ("type_line", "contains") and java_regex("(?P<a>x)") == "(?U)(?<a>x)"
    with pytest.raises(ValueError):
        split_match("name_like")


def test_copy_limits(spark):
    rule = {"default": 1, "exceptions": [{"when": {"type_contains": "basic"}, "limit": None}, {"when": {"text_contains": "any number"}, "limit": None}, {"when": {"text_contains": "up to"}, "limit": {"field": "text", "pattern": r"up to (?P<n>\w+)"}}]}
    rows = [("a", "Basic", "", 12, None), ("b", "", "any number of", 7, None), ("c", "", "", 2, None), ("d", "", "up to nine cards", 11, None), ("e", "", "", 2, 2), ("f", "", "", 1, 0)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "key string, type string, text string, detected long, override long, position int")
    out = {r.key: r.quantity for r in rules.limited(df, rule, "key", [F.col("position")]).collect()}
    assert out == {"a": 12, "b": 7, "c": 1, "d": 9, "e": 2, "f": 0}
    issues = {r.key: r.code for r in rules.copy_issues(rules.limited(df, rule, "key", [F.col("position")]), "key").collect()}
    assert issues == {"c": "copy_limit_exceeded", "d": "copy_limit_exceeded", "e": "copy_limit_violation"}


def test_pips_and_apportionment(spark):
    got = one(spark, rules.pips(F.lit("{W/U}{B/P}{2/R}{G}{3}")))
    assert [(r.color, r.weight) for r in got] == [("W", 0.5), ("U", 0.5), ("B", 0.5), ("R", 0.5), ("G", 1.0)]
    for seed in range(5):
        r = random.Random(seed)
        w = [(0, i, r.choice([0, 1.5, 3.3, 7])) for i in range(6)]
        df = spark.createDataFrame([(g, i, float(x)) for g, i, x in w], "g int, i int, w double")
        assert rank.apportion(df, ["g"], "w", F.lit(10.0), F.col("i")).agg(F.sum("share")).first()[0] == 10
    df = spark.createDataFrame([(0, 0, 3.3), (0, 1, 3.3), (0, 2, 3.4)], "g int, i int, w double")
    assert sorted((r.i, r.share) for r in rank.apportion(df, ["g"], "w", F.lit(10.0), F.col("i")).collect()) == [(0, 3), (1, 3), (2, 4)]


def test_waterfall_conserves(spark):
    d = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "k string, needed long")
    s = spark.createDataFrame([("a", 1, 2, 1), ("b", 9, 0, 0)], "k string, here long, free long, elsewhere long")
    rows = {r.k: (r.here, r.move, r.conflict, r.buy, r.status) for r in multiset.waterfall(d, s, ["k"]).collect()}
    assert rows == {"a": (1, 2, 1, 1, "conflict"), "b": (3, 0, 0, 0, "ok"), "c": (0, 0, 0, 2, "buy")}
    both = multiset.compared(d.withColumnRenamed("needed", "quantity"), s.select("k", F.col("here").alias("quantity")), ["k"])
    assert both.agg(F.sum("missing"), F.sum("extra")).first() == (6, 6)


def test_upserts(spark):
    old, new = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "a"), (2, "b")], [(2, "B"), (3, "c")]))
    assert sorted(map(tuple, upsert.upserted(old, new, ["k"]).collect())) == [(1, "a"), (2, "B"), (3, "c")]
    assert sorted(map(tuple, upsert.inserted(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    cache = spark.createDataFrame([("x", 10.0, 200, "old"), ("x", 20.0, 404, "new"), ("y", 20.0, 500, "bad")], "k string, at double, status int, body string")
    assert [(r.k, r.body) for r in upsert.fresh(cache, "at", F.lit(25.0), 10, ["k"]).collect()] == [("x", "new")]


def test_partition_overwrite(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "v int, g string")
    upsert.replaced_partition(df, str(tmp_path / "t"), ["g"])
    upsert.replaced_partition(spark.createDataFrame([(9, "a")], "v int, g string"), str(tmp_path / "t"), ["g"])
    assert sorted((r.v, r.g) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(2, "b"), (9, "a")]


def test_catalogue(spark, tmp_path):
    cards = [
        {"id": "1", "oracle_id": "o", "lang": "en", "name": "A // B", "layout": "transform", "card_faces": [{"name": "A", "type_line": "Land", "mana_cost": ""}, {"name": "B", "type_line": "Token", "oracle_text": "x"}], "released_at": "2020-02-30"},
        {"id": "2", "lang": "en", "name": "T", "layout": "token", "type_line": "Token Creature", "released_at": "2020-02-03", "prices": {"usd": None}},
    ]
    (tmp_path / "c.jsonl").write_text("[\n" + ",\n".join(map(json.dumps, cards)) + "\n\n]\n")
    flat = catalog.flattened(catalog.read_json_lines(spark, str(tmp_path / "c.jsonl")))
    rows = {r.id: r for r in flat.collect()}
    assert rows["1"].front_name == "A" and rows["1"].type_line == "Land // Token" and rows["1"].oracle_text == "x" and rows["1"].released_at is None
    assert rows["2"].kind == "token" and rows["2"].oracle_id == "2" and rows["1"].kind == "card"
    assert {r.name for r in catalog.names(flat).collect()} == {"A // B", "A", "T"}


def test_listing(spark):
    body = "Commander\n1 Big One (ABC) 12 *F*\n\nDeck:\n4x Plain [xyz]\nOdd Name\n// note\n// Sideboard\n2 Last\nxantid swarm\n2nd sunrise thing\n4 x Two (AB) [Ramp,x y] ^own^\nName My list\nConsidering\n12\n1 Top [Commander{top}] *E*"
    lines = listing.exploded_lines(spark.createDataFrame([(1, body)], "k int, t string"), ["k"], "t")
    got = [(r.zone, r.quantity, r.name, r.set_code, r.collector_number, r.finish) for r in listing.parsed_listing(lines, ["k"]).orderBy("line_no").collect()]
    assert got == [
        ("commander", 1, "Big One", "abc", "12", "foil"), ("deck", 4, "Plain", "xyz", None, "nonfoil"), ("deck", 1, "Odd Name", None, None, "nonfoil"), ("sideboard", 2, "Last", None, None, "nonfoil"),
        ("sideboard", 1, "xantid swarm", None, None, "nonfoil"), ("sideboard", 1, "2nd sunrise thing", None, None, "nonfoil"), ("sideboard", 4, "Two", "ab", None, "nonfoil"),
        ("maybeboard", 1, "12", None, None, "nonfoil"), ("commander", 1, "Top", None, None, "etched"),
    ]
    names = listing.player_names(spark.createDataFrame([(1, "1. Ann\n- Bob\n\nann\n3) Cy")], "k int, t string"), ["k"], "t")
    assert [r.name for r in names.orderBy("line_no").collect()] == ["Ann", "Bob", "Cy"]
    assert one(spark, listing.csv_line(F.lit('a"b'), F.lit(None), F.lit("x,y"))) == '"a""b",,"x,y"'


def test_standings_golden(spark):
    rows = [(0, 1, "A", "B", 2, 0, 0), (0, 1, "C", "D", 2, 1, 0), (0, 2, "A", "C", 2, 1, 0), (0, 2, "B", "D", 1, 1, 1)]
    m = spark.createDataFrame(rows, "contest int, round int, a string, b string, wins_a int, wins_b int, draws int")
    s = {r.player: r for r in contest.standings(m).collect()}
    assert [p for p, _ in sorted(s.items(), key=lambda x: x[1]["rank"])] == ["A", "C", "B", "D"]
    assert s["A"].points == 6 and s["A"].game_rate == pytest.approx(12 / 15) and s["A"].omw == pytest.approx((1 / 3 + 1 / 2) / 2)
    assert s["B"].ogw == pytest.approx((0.8 + 7 / 18) / 2)
    bye = spark.createDataFrame([(0, 1, "P", None, None, None, None)], m.schema)
    r = contest.standings(bye).first()
    assert (r.points, r.byes, r.omw, r.game_rate) == (3, 1, 0.0, 1.0)


def test_round_robin_and_brackets(spark):
    for n in (5, 6):
        rows = contest.round_robin(contest.seat_frame(spark, n)).collect()
        pairs = [frozenset((r.a, r.b)) for r in rows if r.b is not None]
        assert len(pairs) == len(set(pairs)) == n * (n - 1) // 2
        assert [r.a for r in rows if r.b is None].__len__() == (n if n % 2 else 0)
        for k in {r.round for r in rows}:
            seen = [x for r in rows if r.round == k for x in (r.a, r.b) if x is not None]
            assert sorted(seen) == list(range(n))
    assert contest.seed_order(8) == [1, 8, 4, 5, 2, 7, 3, 6]
    seeds = spark.createDataFrame([(0, i, f"s{i}") for i in range(1, 7)], "contest int, seed int, player string")
    results = spark.createDataFrame([(0, 0, 1, "s4"), (0, 0, 3, "s3"), (0, 1, 0, "s9")], "contest int, phase int, slot int, winner string")
    b = {(r.phase, r.slot): r for r in contest.bracket_rounds(seeds, results, 8).collect()}
    assert b[0, 0].winner == "s1" and b[0, 2].winner == "s2" and b[1, 0].stale and b[1, 0].winner is None and (b[1, 0].a, b[1, 0].b) == ("s1", "s4")
    assert [one(spark, contest.pod_sizes(F.lit(n))) for n in (2, 3, 4, 5, 6, 7, 10)] == [[], [3], [4], [5], [3, 3], [4, 3], [4, 3, 3]]


def test_swiss_pairs_properties(spark):
    players = spark.createDataFrame([(c, p, p) for c in range(3) for p in range(1, 8 + c)], "contest int, player int, rank int")
    met = spark.createDataFrame([(c, 1, 2, 1) for c in range(3)], "contest int, a int, b int, met int")
    rows = pairing.swiss_pairs(players, met).collect()
    for c in range(3):
        seen = [x for r in rows if r.contest == c for x in (r.a, r.b) if x is not None]
        assert sorted(seen) == list(range(1, 8 + c)) and sum(r.b is None for r in rows if r.contest == c) == (7 + c) % 2
        assert not any({r.a, r.b} == {1, 2} for r in rows if r.contest == c)


def test_swiss_pairs_of_many_players(spark):
    for n in (128, 129):
        players = spark.createDataFrame([(0, p, p, 3 * ((n - p) // 26), int(p == 129)) for p in range(1, n + 1)], "contest int, player int, rank int, points int, byes int")
        met = spark.createDataFrame([(0, p, p + 5, 1) for p in range(1, n - 5)], "contest int, a int, b int, met int")
        rows = pairing.swiss_pairs(players, met).collect()
        seen = sorted(x for r in rows for x in (r.a, r.b) if x is not None)
        byes = [r.a for r in rows if r.b is None]
        assert seen == list(range(1, n + 1)) and len(byes) == n % 2 and 129 not in byes  # no second bye
        assert not any(abs(r.a - r.b) == 5 for r in rows if r.b is not None)


def test_swiss_rematches_are_swapped_away(spark):
    """Four players of whom the last two would have to meet again."""
    players = spark.createDataFrame([(0, p, p) for p in range(4)], "contest int, player int, rank int")
    met = spark.createDataFrame([(0, 2, 3, 1), (0, 0, 2, 1), (0, 1, 3, 1)], "contest int, a int, b int, met int")
    assert {frozenset((r.a, r.b)) for r in pairing.swiss_pairs(players, met).collect()} == {frozenset((0, 3)), frozenset((1, 2))}


def test_pods_part_who_have_met(spark):
    players = spark.createDataFrame([(0, p, p) for p in range(16)], "contest int, player int, rank int")
    plain = {r.player: r.pod for r in pairing.pods(players).collect()}
    together = [(0, a, b, 1) for a in range(16) for b in range(a + 1, 16) if plain[a] == plain[b]]
    now = {r.player: r.pod for r in pairing.pods(players, spark.createDataFrame(together, "contest int, a int, b int, met int")).collect()}
    assert sum(now[a] == now[b] for _, a, b, _ in together) <= 4 and sorted(list(now.values()).count(k) for k in range(4)) == [4] * 4


def test_pods_use_every_player_once(spark):
    rows = pairing.pods(spark.createDataFrame([(0, p, p) for p in range(14)], "contest int, player int, rank int")).collect()
    sizes = [sum(r.pod == k for r in rows) for k in {r.pod for r in rows}]
    assert sorted(r.player for r in rows) == list(range(14)) and sorted(sizes) == [3, 3, 4, 4]


def test_clusters_keep_captures_apart(spark):
    d = spark.createDataFrame([("s", 1, 1, "x"), ("s", 2, 1, None), ("s", 3, 2, None), ("s", 4, 3, "y"), ("t", 5, 1, None)], "session string, id long, capture long, identity string")
    p = spark.createDataFrame([("s", 1, 3, 0.9, False), ("s", 2, 3, 0.8, False), ("s", 3, 4, 0.7, False), ("s", 2, 4, 0.1, True)], "session string, a long, b long, score double, forced boolean")
    got = {r.id: r.cluster for r in entity.constrained_clusters(d, p).collect()}
    assert got == {1: 1, 3: 1, 2: 2, 4: 2, 5: 5}


def test_swaps_use_each_once(spark):
    m = spark.createDataFrame([(1, "t", 3.0), (2, "t", 4.0)], "id int, g string, s double")
    e = spark.createDataFrame([(7, "t", 3.0), (8, "t", 3.5), (9, "u", 4.0)], "id int, g string, s double")
    assert sorted((r.missing, r.extra) for r in entity.greedy_swaps(m, e, ["g"], "s").collect()) == [(1, 7), (2, 8)]


def frames(n=60, captures=4, seed=1):
    r = random.Random(seed)
    return [(c, i, r.choices(["stable", "unstable", "fast", "empty"], [6, 2, 1, 1])[0], r.choice([0, 0, 0, (1 << 40) - 1]), r.random() * 0.4) for c in range(captures) for i in range(n)]


def test_segments_batch_equals_stream(spark, tmp_path):
    schema = "capture long, idx long, kind string, sig long, x double"
    rows = frames()
    batch = sorted(map(tuple, segments(spark.createDataFrame(rows, schema)).collect()))
    assert batch
    src, n = tmp_path / "in", 0
    for part in range(3):
        more = [f for f in rows if part * 20 <= f[1] < part * 20 + 20] + ([(c, 10**6, "final", 0, 0.0) for c in range(4)] if part == 2 else [])
        spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(str(src))
        n += len(more)
    stream = segments_streamed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src)), idle_ms=None)
    q = stream.writeStream.format("memory").queryName("segments").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("segments").collect())) == batch


class Stored:
    """The state of one capture as the stream's step sees it."""

    def __init__(self):
        self.get, self.exists, self.hasTimedOut, self.wait = None, False, False, None

    def update(self, value):
        self.get, self.exists = value, True

    def remove(self):
        self.get, self.exists = None, False

    def setTimeoutDuration(self, ms):
        self.wait = ms


def test_idle_captures_end_and_leave_no_state():
    step, state = _streamed_step(20, 5000), Stored()
    rows = pd.DataFrame([(7, 1, "stable", 0, 0.0), (7, 0, "stable", 0, 0.0)], columns=["capture", "idx", "kind", "sig", "x"])
    assert pd.concat(step((7,), iter([rows]), state)).empty and state.exists and state.wait == 5000
    state.hasTimedOut = True
    assert pd.concat(step((7,), iter([]), state)).values.tolist() == [[7, 1, 0, 1, 2, "end"]]
    assert not state.exists


def test_unbounded_ingest_of_streams_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="watermark"):
        ingested_once(spark.readStream.schema("k string").parquet(str(tmp_path)), ["k"])


def test_segment_rules():
    def run(*kinds, sigs=None):
        m = Segmenter()
        out = [m.push(i, k, (sigs or [0] * len(kinds))[i], 0.0) for i, k in enumerate(kinds)]
        return [o for o in out if o]

    assert run("stable", "empty", "empty") == [(1, 0, 0, 1, "empty")]
    assert run("stable", "stable", "fast", "stable") == [(1, 0, 1, 2, "moved")]
    assert run("stable", "unstable", "stable") == []
    assert run("stable", "stable", sigs=[0, (1 << 30) - 1]) == [(1, 0, 0, 1, "changed")]


def test_prefix_and_fold(spark):
    g = spark.createDataFrame([(1, 1, False), (1, 2, False), (1, 4, False), (2, 2, True)], "capture int, number int, final boolean")
    assert sorted((r.capture, r.number) for r in contiguous_prefix(g, "capture", "number", "final").collect()) == [(1, 1), (1, 2), (2, 2)]
    f = spark.createDataFrame([(1, 1, "a", 10, 0, False), (1, 2, "a", 2, 1, True), (1, 3, "b", 9, 0, True), (1, 4, "b", 9, 9, True)], "capture long, number long, item string, frames long, gap_before long, left boolean")
    assert [(r.number, r.frames, r.merged) for r in folded(f).orderBy("number").collect()] == [(1, 12, 2), (3, 9, 1), (4, 9, 1)]


def test_hamming_and_geometry(spark):
    a, b = "f" * 64, "0" * 63 + "1"
    assert one(spark, hamming.distance(hamming.from_hex(F.lit(a)), hamming.from_hex(F.lit(b)))) == 255
    quad = lambda x, y: F.array(*[F.array(F.lit(float(i)), F.lit(float(j))) for i, j in ((x, y), (x + 2, y), (x + 2, y + 3), (x, y + 3))])
    assert one(spark, geometry.area(quad(1, 1))) == 6 and one(spark, geometry.centre(quad(0, 0))) == [1.0, 1.5] and one(spark, geometry.angle(quad(0, 0))) == 0
    assert one(spark, geometry.box_overlap(quad(0, 0), quad(1, 0))) == pytest.approx(1 / 3) and one(spark, geometry.width(quad(0, 0))) == 2


def test_running_allowance_equals_greedy(spark):
    r = random.Random(3)
    rows = [(k, i, r.randint(1, 5)) for k in range(5) for i in range(6)]
    df = spark.createDataFrame(rows, "k int, i int, q long")
    got = {(x.k, x.i): x.allowed for x in rank.running_allowance(df, ["k"], [F.col("i")], "q", F.lit(7)).collect()}
    for k, group in itertools.groupby(rows, key=lambda x: x[0]):
        left = 7
        for _, i, q in group:
            assert got[k, i] == min(q, left)
            left -= min(q, left)


def test_frame_quality(spark):
    quad = F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (2, 0), (2, 3), (0, 3))])
    assert one(spark, quality.quality_score(F.lit(1000.0), F.lit(0.0), quad)) == pytest.approx(1.0)
    assert one(spark, quality.sharpness_score(F.lit(0.0))) == 0 and one(spark, quality.near_codes(F.lit("pabc"), F.lit("abc")))
    assert not one(spark, quality.near_codes(F.lit("abc"), F.lit("abd")))


def test_copies_and_sets(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "s"), (2, "b", "t")], "id int, name string, secret string")
    assert [tuple(r) for r in catalog.copied(df, ["id", "secret"], ("secret",), F.col("id") > 1).collect()] == [(2, None)]
    (tmp_path / "s.json").write_text(json.dumps({"data": [{"code": "a", "name": "old"}, {"code": "a", "name": "new", "released_at": "2020-01-01"}]}))
    assert [(r.code, r.name, str(r.released_at)) for r in catalog.sets_from_json(spark, str(tmp_path / "s.json")).collect()] == [("a", "new", "2020-01-01")]
