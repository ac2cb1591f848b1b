"""Batches of like lengths from a stream: a buffer in state, flushed when full and at the end."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_OUT = "lane long, buffer long, bucket long, idx long, length long"


class LengthBuckets(StatefulProcessor):
    """Holds the rows of a lane until ``buffer`` are there, then hands them out in ``buckets`` runs by length.

    Rows come with their place in the lane (from 0), so a buffer is a run of places whatever batches they arrive in: rows
    that have come early wait in list state. What is left is handed out when a row without a length ends the lane, or by
    a timer once nothing has come for ``idle_ms``."""

    def __init__(self, buffer: int, buckets: int, idle_ms: int | None) -> None:
        self.buffer, self.buckets, self.idle = buffer, buckets, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "idx long, length long")
        self.done = handle.getValueState("done", "n long")

    def _handed_out(self, lane: Any, number: int, rows: list[tuple[int, int]]) -> pd.DataFrame:
        ordered = sorted(rows, key=lambda r: (r[1], r[0]))
        size = len(ordered) // self.buckets
        bucket = [0 if not size else min(k // size, self.buckets - 1) for k in range(len(ordered))]
        return pd.DataFrame({"lane": lane, "buffer": number, "bucket": bucket, "idx": [r[0] for r in ordered], "length": [r[1] for r in ordered]})

    def _state(self) -> tuple[int, list[tuple[int, int]]]:
        return (self.done.get()[0] if self.done.exists() else 0), [(r[0], r[1]) for r in self.rows.get()]

    def _keep(self, done: int, rows: list[tuple[int, int]]) -> None:
        self.done.update((done,))
        if rows:
            self.rows.put(rows)
        elif self.rows.exists():
            self.rows.clear()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        done, held = self._state()
        ended = False
        for pdf in rows:
            some = pdf["length"].notna()
            ended |= not some.all()
            held += zip(pdf["idx"][some].astype(int), pdf["length"][some].astype(int), strict=True)
        held.sort()
        while len(held) >= self.buffer and held[self.buffer - 1][0] == (done + 1) * self.buffer - 1:
            yield self._handed_out(key[0], done, held[: self.buffer])
            held, done = held[self.buffer :], done + 1
        if ended and held:
            yield self._handed_out(key[0], done, held)
            held, done = [], done + 1
        self._keep(done, held)
        if self.idle is None:
            return
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if held:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        done, held = self._state()
        if held:
            held.sort()
            yield self._handed_out(key[0], done, held)
            self._keep(done + 1, [])

    def close(self) -> None:
        pass


def bucketed_lengths(stream: DataFrame, buffer: int, buckets: int, idle_ms: int | None = None) -> DataFrame:
    """(lane, buffer, bucket, idx, length) of a stream of rows (lane, idx, length): rows of a lane in runs of ``buffer``
    places, each in ``buckets`` equal runs by length, the last with the remainder, as length_buckets() makes them of a table.

    A row with a null length ends its lane; with ``idle_ms`` so does silence, by processing time, for streams that run on
    (a stream with such timers has no end of its own). State is a lane's unfinished buffer; the checkpoint restores it, so that a restart loses and repeats nothing. Lanes
    are what spreads over tasks: give a hot source several. Needs the RocksDB state store."""
    rows = stream.selectExpr("cast(lane as long) lane", "cast(idx as long) idx", "cast(length as long) length")
    return rows.groupBy("lane").transformWithStateInPandas(LengthBuckets(buffer, buckets, idle_ms), _OUT, "append", "none" if idle_ms is None else "processingtime")
