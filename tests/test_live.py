from __future__ import annotations

import random

import pandas as pd

from tallyforge.streaming.live import OUT, LiveSegmenter, _step, live_segments, live_segments_streamed
from tallyforge.streaming.segments import folded, segments

FAR = (1 << 40) - 1
FRAME = "capture long, idx long, kind string, sig long, x double"
ANSWER = "capture long, idx long, kind string, number int"


def pushed(m, frames, start=0):
    return [t for i, f in enumerate(frames) for t in m.push(start + i, *f)]


def test_told_once():
    m = LiveSegmenter()
    assert pushed(m, [("stable", 0, 0.9)] * 6) == [(1, 3, 4, False, [0, 1, 2])]
    assert pushed(m, [("stable", FAR, 0.9), ("stable", 0, 0.9)], 6) == []  # one odd frame changes nothing
    assert m.rearm() and not m.rearm()
    assert pushed(m, [("stable", 0, 0.9)] * 4, 8) == [(2, 11, 4, False, [8, 9, 10])]
    assert pushed(m, [("empty", 0, 0.0)] * 6, 20) == [] and m.sig is None
    assert pushed(LiveSegmenter(), [("stable", 0, 0.3)] * 14) == [(1, 11, 12, True, [0, 1, 2])]


def test_change_needs_two_frames_and_best_are_kept():
    m = LiveSegmenter()
    told = pushed(m, [("stable", 0, s) for s in (0.7, 0.9, 0.8, 0.95)] + [("stable", FAR, 0.9)] * 6)
    assert told == [(1, 3, 4, False, [3, 1, 2]), (2, 8, 4, False, [5, 6, 7])]


def test_closing_tells_steady_groups_and_drops_doubtful_ones():
    gone = [("empty", 0, 0.0)] * 6
    assert pushed(LiveSegmenter(), [("stable", 0, 0.6)] * 5 + gone) == [(1, 10, 5, False, [0, 1, 2])]
    assert pushed(LiveSegmenter(), [("stable", 0, 0.4)] * 5 + gone) == []
    assert pushed(LiveSegmenter(), [("stable", 0, 0.9)] * 3 + gone) == []


def test_one_retry_and_rejects_are_final():
    m = LiveSegmenter()
    pushed(m, [("stable", 0, 0.9)] * 4)
    assert not m.rearm(2) and m.rearm(1)
    assert pushed(m, [("stable", 0, 0.9)] * 4, 4) == [(2, 7, 4, False, [4, 5, 6])]
    assert not m.rearm(2)
    n = LiveSegmenter()
    pushed(n, [("stable", 0, 0.9)] * 4)
    assert n.reject(1) and not n.rearm(1) and pushed(n, [("stable", 0, 0.9)] * 20, 4) == []


def test_state_is_bounded_and_resumes():
    r, m, most = random.Random(2), LiveSegmenter(), 0
    for i in range(5000):
        m = LiveSegmenter().resume(m.state())
        m.push(i, r.choice(["stable"] * 8 + ["empty", "fast"]), r.choice([0, 0, 0, FAR]), r.random())
        most = max(most, len(m.state()))
        assert len(m.best) <= 3 and len(m.recent) <= 8 and len(m.scores) <= 12
    assert most < 1000


def planted(seed=7):
    r = random.Random(seed)
    frames, answers = [], []
    for c in range(6):
        for i in range(90):
            frames.append((c, i, r.choice(["stable"] * 9 + ["empty", "fast", "unstable", None]), [0, FAR, (1 << 62) - 1][i // 25 % 3], r.choice([0.3, 0.8, 0.9, 0.95, None])))
            if r.random() < 0.15:
                answers.append((c, i, r.choice(["rearm", "reject"]), r.choice([1, 2, 3, None])))
    return frames, answers


def alone(frames, answers):
    out = []
    for c in {f[0] for f in frames}:
        m = LiveSegmenter()
        rows = sorted([(f[1], 0, f[2], f[3], f[4], None) for f in frames if f[0] == c] + [(a[1], 1, a[2], None, None, a[3]) for a in answers if a[0] == c], key=lambda x: x[:2])
        out += [(c, *t) for i, _, kind, sig, x, number in rows for t in m.take(i, kind, sig, x, number)]
    return sorted(out, key=str)


def test_stream_with_answers_equals_batch(spark, tmp_path):
    frames, answers = planted()
    want = alone(frames, answers)
    assert {w[-1] for w in want} == {"told", "rearmed", "rejected", "ignored"}
    got = live_segments(spark.createDataFrame(frames, FRAME), spark.createDataFrame(answers, ANSWER))
    assert sorted([tuple(r) for r in got.collect()], key=str) == want
    for name, rows, schema in (("f", frames, FRAME), ("a", answers, ANSWER)):
        for lo, hi in ((0, 30), (30, 90)):
            spark.createDataFrame([x for x in rows if lo <= x[1] < hi], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    streams = [spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n)) for n, s in (("f", FRAME), ("a", ANSWER))]
    q = live_segments_streamed(*streams, idle_ms=None).writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted([tuple(r) for r in spark.table("live").collect()], key=str) == want


class State:
    """As much of a group's state as the step uses."""

    hasTimedOut, exists, removed, timeout = False, False, False, None

    def update(self, value):
        self.exists, self.get = True, value

    def remove(self):
        self.removed = True

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def test_captures_end_by_time_and_by_final():
    frame = lambda kind: pd.DataFrame([(1, 0, kind, "0", 0.9, None, False)], columns=["capture", "idx", "kind", "sig", "score", "number", "answer"])
    state = State()
    assert [len(x) for x in _step(50)((1,), iter([frame("stable")]), state)] == [0] and state.timeout == 50
    state.hasTimedOut = True
    assert list(_step(50)((1,), iter([]), state)) == [] and state.removed
    other = State()
    list(_step(50)((1,), iter([frame("final")]), other))
    assert other.removed and not other.exists


def test_empty_and_null_captures(spark):
    none = live_segments(spark.createDataFrame([], FRAME))
    assert none.count() == 0 and [f.name for f in none.schema] == [c.split(" ")[0] for c in OUT.split(", ")]
    rows = [(None, i, "stable", 0, 0.9) for i in range(5)]
    assert [tuple(r)[:3] for r in live_segments(spark.createDataFrame(rows, FRAME)).collect()] == [(None, 1, 3)]
    assert [tuple(r) for r in segments(spark.createDataFrame(rows, FRAME)).collect()] == [(None, 1, 0, 4, 5, "end")]
    assert folded(spark.createDataFrame([(None, 1, "a", 3, 0, False)], "capture long, number long, item string, frames long, gap_before long, left boolean")).count() == 1


def test_long_captures_cross_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        r = random.Random(4)
        rows = [(c, i, r.choice(["stable", "stable", "fast"]), 0, 0.0) for c in range(3) for i in range(50)]
        got = segments(spark.createDataFrame(rows, FRAME)).groupBy("capture").sum("frames").collect()
        assert {x[0]: x[1] for x in got} == {c: sum(f[0] == c and f[2] == "stable" for f in rows) for c in range(3)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
