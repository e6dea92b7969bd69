"""Groups of frames told while they are seen, and what their receiver answers: one machine for batch and stream.

Rows are frames and answers of one sequence a capture, in the order of ``idx``. A frame has kind ``empty``, ``fast``,
``unstable`` or ``stable``, its signature and its score. An answer has kind ``rearm`` (tell the open group again) or
``reject`` (it was no card) and the ``number`` that the group was told with; ``final`` ends the capture. At one idx,
frames come before answers. Null kinds count as ``empty``, null signatures and scores as 0.
"""

from __future__ import annotations

import json
import statistics
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .carried import carried

OUT = "capture long, number int, emitted long, frames int, doubtful boolean, best array<long>, what string"
COLUMNS = [c.split(" ")[0] for c in OUT.split(", ")]
#: Frames of a group that are kept for the receiver, and signatures that a frame is compared with.
KEPT, RECENT = 3, 8
ANSWERS = ("rearm", "reject")
#: A capture without rows for so long ends.
IDLE_MS = 3_600_000


def _bits(a: int, b: int) -> int:
    return ((a ^ b) & (1 << 64) - 1).bit_count()


class LiveSegmenter:
    """Groups told early: after ``steady`` stable frames, later if the picture is doubtful.

    A pause of six frames that ends empty closes a group; motion does not. A frame unlike the group's recent ones closes
    it if the next stable frame is like that frame. A group that closes untold is told then if it is long enough and not
    doubtful, else dropped. A told group may be told once more (``rearm``), unless it was rejected. The state is bounded:
    scores are kept until a group is told, three best frames and eight signatures.
    """

    def __init__(self, steady: int = 4, late: int = 12, doubt: float = 0.5, sure: float = 0.7, pause: int = 6, split: int = 20, retries: int = 1) -> None:
        self.steady, self.late, self.doubt, self.sure, self.pause, self.split, self.most = steady, late, doubt, sure, pause, split, retries
        self.number, self.waits, self.candidate = 0, 0, None
        self.reset()

    def reset(self) -> None:
        self.frames, self.sig, self.told, self.rejected, self.retried, self.name = 0, None, False, False, 0, 0
        self.scores: list[float] = []
        self.best: list[list] = []
        self.recent: list[int] = []

    def state(self) -> str:
        return json.dumps([self.number, self.waits, self.candidate, self.frames, self.sig, self.told, self.rejected, self.retried, self.name, self.scores, self.best, self.recent])

    def resume(self, state: str) -> LiveSegmenter:
        self.number, self.waits, self.candidate, self.frames, self.sig, self.told, self.rejected, self.retried, self.name, self.scores, self.best, self.recent = json.loads(state)
        return self

    def rearm(self, number: int | None = None) -> bool:
        """Lets the open group be told once more; False if it is another group, untold, rejected or out of retries."""
        if not self.told or (number is not None and number != self.name) or self.rejected or self.retried >= self.most:
            return False
        self.told, self.retried, self.frames, self.scores, self.best = False, self.retried + 1, 0, [], []
        return True

    def reject(self, number: int | None = None) -> bool:
        """Marks the open group as no card; it is not told again."""
        if not self.told or (number is not None and number != self.name):
            return False
        self.rejected = True
        return True

    def push(self, idx: int, kind: str, sig: int, score: float) -> list[tuple]:
        """Takes a frame; the groups (number, idx, frames, doubtful, best) that are told with it, in order."""
        if kind != "stable":
            self.waits += 1
            return self.close(idx) if kind == "empty" and self.waits >= self.pause and self.sig is not None else []
        out = []
        if self.sig is not None and _bits(sig, self.sig) > self.split and all(_bits(sig, r) > self.split for r in self.recent):
            if self.candidate is None or _bits(sig, self.candidate) > self.split:
                self.candidate, self.waits = sig, self.waits + 1
                return []
            out = self.close(idx)
        self.candidate, self.waits = None, 0
        self.recent = [*self.recent, sig][-RECENT:]
        if self.told:
            return out
        self.frames += 1
        self.scores.append(score)
        self.best = sorted([*self.best, [score, idx, sig]], key=lambda b: -b[0])[:KEPT]
        self.sig = self.best[0][2]
        middle = statistics.median(self.scores)
        if self.frames < (self.steady if middle >= self.sure else self.late):
            return out
        return [*out, self.tell(idx, middle < self.doubt)]

    def tell(self, idx: int, doubtful: bool) -> tuple:
        self.told, self.number = True, self.number + 1
        self.name, self.scores = self.number, []
        return (self.number, idx, self.frames, doubtful, [b[1] for b in self.best])

    def close(self, idx: int) -> list[tuple]:
        steady = not self.told and self.frames >= self.steady and statistics.median(self.scores) >= self.doubt
        out = [self.tell(idx, False)] if steady else []
        self.reset()
        return out

    def take(self, idx: int, kind: str | None, sig: int | None, score: float | None, number: int | None, _: bool = False) -> list[tuple]:
        """A frame or an answer; rows (number, idx, frames, doubtful, best, what) with what ``told``, ``rearmed``,
        ``rejected`` or ``ignored``."""
        if kind in ANSWERS:
            name, frames, best = self.name, self.frames, [b[1] for b in self.best]
            done = number is not None and (self.rearm(number) if kind == "rearm" else self.reject(number))
            return [(name, idx, frames, False, best, f"{kind}ed")] if done else [(number, idx, 0, False, [], "ignored")]
        return [(*told, "told") for told in self.push(idx, kind or "empty", sig or 0, score or 0.0)]

    def end(self) -> list[tuple]:
        return []


def _rows(frames: DataFrame, answers: DataFrame | None) -> DataFrame:
    shown = frames.select(F.col("capture").cast("long").alias("capture"), F.col("idx").cast("long").alias("idx"), "kind", F.col("sig").cast("long").alias("sig"), F.col("x").cast("double").alias("score"), F.lit(None).cast("int").alias("number"), F.lit(False).alias("answer"))
    if answers is None:
        return shown
    told = answers.select(F.col("capture").cast("long").alias("capture"), F.col("idx").cast("long").alias("idx"), "kind", F.lit(None).cast("long").alias("sig"), F.lit(None).cast("double").alias("score"), F.col("number").cast("int").alias("number"), F.lit(True).alias("answer"))
    return shown.unionByName(told)


def live_segments(frames: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Groups as they would be told live (frames: capture, idx, kind, sig, x as the picture's score), and what became of
    the answers (capture, idx, kind, number). A group that is open and untold at the end is told in neither form."""
    return carried(_rows(frames, answers), "capture", ["idx", "answer"], LiveSegmenter, OUT)


def _step(idle_ms: int | None):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        machine, out, over = LiveSegmenter(), [], False
        if state.exists:
            machine.resume(state.get[0])
        # sigs pass as text: a pandas column of longs with nulls would round them
        rows = pd.concat(list(batches)).sort_values(["idx", "answer", "kind", "sig", "score", "number"])
        for idx, kind, sig, score, number in rows[["idx", "kind", "sig", "score", "number"]].itertuples(index=False):
            if kind == "final":
                over = True
                break
            plain = [None if pd.isna(v) else v for v in (kind, sig, score, number)]
            out += machine.take(int(idx), plain[0], int(plain[1]) if plain[1] is not None else None, plain[2], int(plain[3]) if plain[3] is not None else None)
        if over:
            state.remove()
        else:
            state.update((machine.state(),))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(key[0], *o) for o in out], columns=COLUMNS)

    return run


def live_segments_streamed(frames: DataFrame, answers: DataFrame, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """The same over two streams, frames and answers, which meet in one state a capture.

    Rows of a batch are put in order of idx; ``final`` (as a frame's kind) or ``idle_ms`` without rows ends a capture, so
    state is kept for live captures only and is bounded for each. Time-outs need a ``processingTime`` trigger
    and never come to rest; sources that end every capture themselves may pass None.
    """
    rows = _rows(frames, answers).withColumn("sig", F.col("sig").cast("string"))
    return rows.groupBy("capture").applyInPandasWithState(_step(idle_ms), OUT, "state string", "append", "ProcessingTimeTimeout" if idle_ms else "NoTimeout")
