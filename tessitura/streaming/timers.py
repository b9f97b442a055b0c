"""Pairing of notes on a stream with timers, so that no note stays open for ever.

The state is a value per piece: its open notes and, by sequence, what has been
paired. A note-off closes the open note of its pitch with the least sequence; a
note that nothing has closed within ``longest`` of event time is closed by a
timer, and its state goes. Dropped are events that come after the watermark has
passed them, offs without an open note, and repeated events by sequence: an on
that is open or an off that has closed a note is seen once while its time runs.
A piece's state is read and written once per call and its timer is that of its
first note to end, so the calls to the state don't grow with the events.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RESULT = "piece_id long, pitch int, start_seq long, end_seq long, reason string"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB, which map states
    and timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class PairNotes(StatefulProcessor):
    def __init__(self, longest_ms: int) -> None:
        self.longest = longest_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.notes = handle.getValueState("notes", "pitch array<int>, seq array<long>, until array<long>, done array<boolean>")

    def _load(self) -> tuple[defaultdict[int, list], dict]:
        """By pitch, a heap of the (sequence, until) of its open notes; and the
        until of paired events by (pitch, sequence)."""
        opened, done = defaultdict(list), {}
        for pitch, seq, until, is_done in zip(*self.notes.get(), strict=True) if self.notes.exists() else ():
            if is_done:
                done[pitch, seq] = until
            else:
                opened[pitch].append((seq, until))
        for heap in opened.values():
            heapq.heapify(heap)
        return opened, done

    def _save(self, opened: dict[int, list], done: dict) -> None:
        rows = [(p, s, u, False) for p, heap in opened.items() for s, u in heap] + [(p, s, u, True) for (p, s), u in done.items()]
        if rows:
            self.notes.update(tuple(map(list, zip(*rows, strict=True))))
            self.handle.registerTimer(min(u for _, _, u, _ in rows))
        elif self.notes.exists():
            self.notes.clear()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        out, now = [], timerValues.getCurrentWatermarkInMs()
        opened, done = self._load()
        known = done.keys() | {(p, s) for p, heap in opened.items() for s, _ in heap}
        for at, seq, d, pitch in sorted(x for pdf in rows for x in zip(*(pdf[c].tolist() for c in ("at", "seq", "d", "pitch")), strict=True)):
            if at < now or (pitch, seq) in known:
                continue
            until = max(at + self.longest, now + 1)
            if d == 1:
                heapq.heappush(opened[pitch], (seq, until))
            elif opened[pitch]:
                least, _ = heapq.heappop(opened[pitch])
                out.append((key[0], pitch, least, seq, "paired"))
                done[pitch, least] = done[pitch, seq] = until
            else:
                continue
            known.add((pitch, seq))
        self._save(opened, done)
        yield _rows(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        # By the watermark, which may have passed several ends at once.
        now = timerValues.getCurrentWatermarkInMs()
        opened, done = self._load()
        hanging = sorted((p, s) for p, heap in opened.items() for s, u in heap if u <= now)
        left = {p: [x for x in heap if x[1] > now] for p, heap in opened.items()}
        self._save(left, {k: u for k, u in done.items() if u > now})
        yield _rows([(key[0], p, s, None, "hanging") for p, s in hanging])

    def close(self) -> None:
        pass


def _rows(found: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(found, columns=["piece_id", "pitch", "start_seq", "end_seq", "reason"])
    return out.astype({"piece_id": "int64", "pitch": "int32", "start_seq": "Int64", "end_seq": "Int64", "reason": "object"})


def paired_or_closed(events: DataFrame, longest_ms: int, late: str = "1 hour") -> DataFrame:
    """(piece_id, pitch, start_seq, end_seq, reason): ``paired``, or ``hanging``
    with a null end. ``events``: (piece_id, pitch, ts, seq, d), d 1 for a note-on
    and -1 for a note-off. Start the query inside :func:`rocks`."""
    keyed = events.select("piece_id", "pitch", "ts", F.unix_millis("ts").alias("at"), "seq", "d").withWatermark("ts", late).groupBy("piece_id")
    return keyed.transformWithStateInPandas(PairNotes(longest_ms), RESULT, outputMode="Append", timeMode="EventTime")
