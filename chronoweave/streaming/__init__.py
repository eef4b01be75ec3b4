"""Windowed counts and order-dependent scans as streams, with watermarks, event-time timers and state that expires."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Watermarks begin at the epoch, and rows not after them are late; so times, which may begin at 0, are seen this many microseconds later.
ORIGIN_US = 10**15


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Tumbling windows with a watermark: number and sum of values by key."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


class InOrder(StatefulProcessor):
    """Takes each key's rows in order of time, whatever order they come in.

    Rows wait in state until the watermark passes them; a timer then hands all that are due to ``step(kept, rows)``, which returns the
    state to keep (a tuple, or None) and the rows to tell.  A key without rows for ``idle_us`` after its last one loses its state.  Without a
    watermark (``idle_us`` None) there are no timers: the rows of each batch are taken as they come, and those not after the last one
    are dropped.  A row is (time, key, value); the key goes back into what is told.
    """

    def __init__(self, step: Callable, key: str, told: list[str], kept: str, value: str, idle_us: int | None):
        self.step, self.key, self.told, self.kept, self.value, self.idle_us = step, key, told, kept, value, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")
        self.memory = handle.getValueState("kept", self.kept)
        if self.idle_us is not None:
            self.waiting = handle.getListState("waiting", "at long, value " + self.value)

    def _rows(self, batches: Iterable[pd.DataFrame]) -> list[tuple]:
        plain = lambda v: v.tolist() if isinstance(v, np.ndarray) else v
        return [(int(at), plain(v)) for b in batches for at, v in zip(b["at_"], b["value_"], strict=True)]

    def _wake(self, at_us: int) -> None:
        """A timer for when the watermark has passed this time."""
        self.handle.registerTimer(-(-(at_us + ORIGIN_US) // 1000))

    def _take(self, key: tuple, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        after, out = self.step(tuple(self.memory.get()) if self.memory.exists() else None, rows)
        if after is None:
            self.memory.clear()
        else:
            self.memory.update(after)
        self.last.update((max(at for at, _ in rows),))
        if out:
            yield pd.DataFrame([(key[0], *o) for o in out], columns=[self.key, *self.told])

    def _runs(self, rows: list[tuple]) -> list[list[tuple]]:
        """Rows in order, cut where none comes for ``idle_us``, so that state ends there whenever the timers ring."""
        out: list[list[tuple]] = []
        for r in rows:
            if out and r[0] - out[-1][-1][0] < self.idle_us:
                out[-1].append(r)
            else:
                out.append([r])
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = self._rows(rows)
        if self.idle_us is None:
            last = self.last.get()[0] if self.last.exists() else None
            new = sorted((r for r in new if last is None or r[0] > last), key=lambda r: r[0])
            if new:
                yield from self._take(key, new)
        elif new:
            self.waiting.appendList(new)
            self._wake(min(at for at, _ in new))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000 - ORIGIN_US
        held = sorted(((int(r[0]), r[1]) for r in self.waiting.get()), key=lambda r: r[0])
        due, rest = [r for r in held if r[0] <= passed], [r for r in held if r[0] > passed]
        if due:
            for run in self._runs(due):
                if self.last.exists() and run[0][0] - self.last.get()[0] >= self.idle_us:
                    self.memory.clear()
                yield from self._take(key, run)
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        if rest:
            self._wake(rest[0][0])
        elif self.last.exists():
            end = self.last.get()[0] + self.idle_us
            if end > passed:
                self._wake(end)
            else:
                self.last.clear()
                self.memory.clear()

    def close(self) -> None:
        pass


def _in_order(rows: DataFrame, key: str, at, value, step: Callable, told: str, kept: str, late: str | None, idle_us: int) -> DataFrame:
    spark = rows.sparkSession
    # Timers and lists in state need this store; a query keeps the store that its checkpoint names.
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    keyed = rows.where(at.isNotNull()).select(key, at.alias("at_"), value.alias("value_"), F.timestamp_micros(at + ORIGIN_US).alias("ts_"))
    keyed = keyed.withWatermark("ts_", late) if late else keyed.drop("ts_")
    kinds = {f.name: f.dataType.simpleString() for f in keyed.schema}
    names = [x.split()[0] for x in told.split(", ")]
    processor = InOrder(step, key, names, kept, kinds["value_"], idle_us if late else None)
    return keyed.groupBy(key).transformWithStateInPandas(processor, f"`{key}` {kinds[key]}, {told}", "Append", "EventTime" if late else "None")


def thin(events: DataFrame, key: str, step_us: int, t: str = "t", late: str | None = None, idle_us: int = 3_600_000_000) -> DataFrame:
    """Greedy thinning along a stream: a point stays if it is ``step_us`` or more after the last one that stayed.

    With ``late`` (a watermark over ``t``, microseconds) points are told when the watermark has passed them, in their own order, so
    batches may come in any order within that bound and the points are those of the batch operator; later ones are dropped.  A key's
    state is its last point and what the watermark hasn't passed, and ends ``idle_us`` (no less than a step) after its last point,
    which changes nothing.  Without ``late`` the points of each batch are told at once, and those not after the last one seen are dropped.
    """

    def step(kept, rows):
        last, out = (kept[0] if kept else None), []
        for at, _ in rows:
            if last is None or at - last >= step_us:
                out.append((at,))
                last = at
        return (None if last is None else (int(last),)), out

    return _in_order(events, key, F.col(t).cast("long"), F.lit(True), step, f"{t} long", "at long", late, max(idle_us, step_us))


def track(detections: DataFrame, key: str, least: float = 0.2, late: str | None = None, idle_us: int = 3_600_000_000) -> DataFrame:
    """``track_subject`` along a stream of frames: ``(key, pts, det_idx, reset, quality)``.

    ``detections``: pts, and ``boxes``, an array of (det_idx, l, t, r, b) that is empty in a frame without any, so that a frame is one row;
    of rows with one pts the first counts alone.  State is one box.  With ``late`` (a watermark over ``pts``, microseconds) frames are taken when
    the watermark has passed them, so they may come in any order within that bound; later ones are dropped, and a track ends where
    no frame comes for ``idle_us``.  Without ``late`` frames of one batch are put in order, and those not after the last one are dropped.
    """
    from ..operators.probe import Track

    def step(kept, rows):
        tracker, out, seen = Track(least), [], None
        if kept is not None:
            tracker.state = np.array(kept, dtype=float)
        for pts, boxes in rows:
            if pts == seen:
                continue
            seen = pts
            flat = [float("nan") if x is None else float(x) for x in (() if boxes is None else boxes)]
            found = sorted((int(flat[i]), *flat[i + 1 : i + 5]) for i in range(0, len(flat), 5))
            if (got := tracker.step(found)) is not None:
                out.append((pts, *got))
        return (None if tracker.state is None else tuple(float(z) for z in tracker.state)), out

    # Lists in state hold flat arrays: five numbers for each box.
    boxes = F.flatten(F.transform("boxes", lambda b: F.array(*(b[c].cast("double") for c in ("det_idx", "l", "t", "r", "b")))))
    told = "pts long, det_idx int, reset boolean, quality double"
    return _in_order(detections, key, F.col("pts").cast("long"), boxes, step, told, "l double, t double, r double, b double", late, idle_us)
