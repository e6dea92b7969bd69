"""Segments of ordered frames: one state machine for batches and for Structured Streaming.

A group opens on the first stable frame. It closes on an empty frame that is not the first frame of its pause, on a
stable frame after the card left or moved fast, on a signature that differs in more than ``split`` bits, or on a small overlap after unstable frames. Frames have
capture, idx, kind (empty, fast, unstable, stable), sig (long) and x (position).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .carried import carried

ORDER = {"stable": 0, "unstable": 1, "fast": 2, "empty": 3}
OUT = "capture long, number int, first long, last long, frames int, why string"


class Segmenter:
    """The state of one capture; plain values only, so that it can be stored between batches."""

    def __init__(self, split: int = 20, near: float = 0.7, state: tuple | None = None) -> None:
        self.split, self.near = split, near
        self.number, self.first, self.last, self.frames, self.sig, self.x, self.worst, self.waits = state or (0, -1, -1, 0, 0, 0.0, 0, 0)

    def state(self) -> tuple:
        return (self.number, self.first, self.last, self.frames, self.sig, self.x, self.worst, self.waits)

    def push(self, idx: int, kind: str, sig: int, x: float) -> tuple | None:
        """Takes a frame; the group (number, first, last, frames, why) that it closes, if any."""
        if kind != "stable":
            self.worst = max(self.worst, ORDER[kind])
            self.waits += 1
            return self.close("empty") if kind == "empty" and self.waits >= 2 and self.frames else None
        out = None
        if self.frames:
            if self.worst >= ORDER["fast"]:
                out = self.close("moved")
            elif ((sig ^ self.sig) & (1 << 64) - 1).bit_count() > self.split:
                out = self.close("changed")
            elif self.worst == ORDER["unstable"] and self.overlap(x, self.x) < self.near:
                out = self.close("shifted")
        if not self.frames:
            self.first = idx
        self.last, self.frames, self.sig, self.x, self.worst, self.waits = idx, self.frames + 1, sig, x, 0, 0
        return out

    def close(self, why: str) -> tuple:
        self.number += 1
        out = (self.number, self.first, self.last, self.frames, why)
        self.frames = 0
        return out

    def overlap(self, x, before) -> float:
        """How much two places have in common."""
        return 1 - abs(x - before)

    def take(self, *frame) -> list[tuple]:
        closed = self.push(*frame)
        return [closed] if closed else []

    def end(self) -> list[tuple]:
        return [self.close("end")] if self.frames else []


def _rows(capture: int, closed: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(capture, *c) for c in closed], columns=["capture", "number", "first", "last", "frames", "why"])


def segments(frames: DataFrame, split: int = 20) -> DataFrame:
    """Groups of every capture; what is open at its end closes with it. A capture is one ordered sequence, read in batches:
    a task holds one batch and the state."""
    return carried(frames.select("capture", "idx", "kind", "sig", "x"), "capture", ["idx"], lambda: Segmenter(split), OUT)


def _streamed_step(split: int, idle_ms: int | None):
    """One batch of one capture, or its time-out: takes the stored state further and gives the groups that close."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        machine = Segmenter(split, state=tuple(state.get) if state.exists else None)
        closed, over = [], state.hasTimedOut
        if not over:
            for idx, kind, sig, x in pd.concat(list(batches)).sort_values("idx")[["idx", "kind", "sig", "x"]].itertuples(index=False):
                if kind == "final":
                    over = True
                elif out := machine.push(idx, kind, sig, x):
                    closed.append(out)
        if over:
            if machine.frames:
                closed.append(machine.close("end"))
            state.remove()
        else:
            state.update(machine.state())
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        yield _rows(key[0], closed)

    return run


#: A capture without frames for an hour ends.
IDLE_MS = 3_600_000


def segments_streamed(frames: DataFrame, split: int = 20, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """The same over a stream: a frame of kind ``final`` ends its capture. Frames of a batch are put in order of idx.

    A capture without frames for ``idle_ms`` (processing time) ends too, so that state is kept for live captures only;
    frames that come after that open a capture anew, with groups numbered from one. This needs a ``processingTime``
    trigger: with ``availableNow`` such a stream would wait for time-outs without end. Sources that end every capture
    themselves may pass None; state then stays until ``final`` comes.
    """
    stored = "number int, first long, last long, frames int, sig long, x double, worst int, waits int"
    return frames.groupBy("capture").applyInPandasWithState(_streamed_step(split, idle_ms), OUT, stored, "append", "ProcessingTimeTimeout" if idle_ms else "NoTimeout")


def contiguous_prefix(groups: DataFrame, capture: str, number: str, final: str) -> DataFrame:
    """Groups 1..n of a capture without a gap; all of them once the capture is final."""
    from pyspark.sql import Window

    w = Window.partitionBy(capture)
    rows = groups.withColumn("__nth", F.row_number().over(w.orderBy(number))).withColumn("__over", F.max(F.col(final).cast("int")).over(w))
    return rows.where((F.col("__nth") == F.col(number)) | (F.col("__over") == 1)).drop("__nth", "__over")


def ingested_once(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Idempotent ingest of a table: a key that comes again is the same row. Streams take ``flows.ingested_once``, whose
    state a watermark bounds; they are refused here."""
    if rows.isStreaming:
        raise ValueError("a stream needs flows.ingested_once, which bounds its state by a watermark")
    return rows.dropDuplicates(keys)


def folded(groups: DataFrame, short: int = 4, gap: int = 3, span: float = 1.6) -> DataFrame:
    """Merges fragments of one card (capture, number, item, frames, gap_before, left): a group joins the one before if it
    is the same item and the card did not leave, or if it is short, close and fits ``span`` medians; the order matters,
    as each merge changes what the next group is compared with. Medians are an aggregate of their own; a task holds one
    batch and the last group."""
    medians = groups.groupBy("capture").agg(F.expr("percentile(frames, 0.5)").alias("__median")).withColumnRenamed("capture", "__capture")
    rows = groups.join(medians, F.col("capture").eqNullSafe(F.col("__capture"))).select("capture", "number", "item", "frames", "gap_before", "left", "__median")
    return carried(rows, "capture", ["number"], lambda: Folder(short, gap, span), "capture long, number long, item string, frames long, merged long")


class Folder:
    """The last group, which the next one may join."""

    def __init__(self, short: int, gap: int, span: float) -> None:
        self.short, self.gap, self.span, self.last = short, gap, span, None

    def take(self, number: int, item: str, frames: int, before: int, left: bool, median: float) -> list[tuple]:
        last = self.last
        if last and last[1] == item and (not left or (frames < self.short and before <= self.gap and last[2] + frames <= self.span * median)):
            last[2] += frames
            last[3] += 1
            return []
        self.last = [number, item, frames, 1]
        return [tuple(last)] if last else []

    def end(self) -> list[tuple]:
        return [tuple(self.last)] if self.last else []


def hidden_copies(angles: DataFrame, least: float = 1.8, margin: int = 5) -> DataFrame:
    """Where a long group's angles (capture, number, angles) change most: the split whose medians differ most, if by
    ``least`` degrees; ``margin`` frames stay on either side. All with array functions."""
    n = F.size("angles")
    middle = lambda a: F.element_at(F.sort_array(a), (F.floor((F.size(a) - 1) / 2) + 1).cast("int"))
    cuts = F.sequence(F.lit(margin), n - margin)
    gaps = F.transform(cuts, lambda c: F.struct(F.abs(middle(F.slice(F.col("angles"), F.lit(1), c)) - middle(F.slice(F.col("angles"), c + 1, F.size(F.col("angles"))))).alias("gap"), (-c).alias("order")))
    best = F.array_max(gaps)
    rows = angles.where(n >= 2 * margin).withColumn("best", best).where(F.col("best.gap") >= least)
    return rows.select("capture", "number", (-F.col("best.order")).alias("cut"), F.round("best.gap", 6).alias("gap"))
