"""Debounce by timers: exact to the microsecond, and the same whatever the order in which events arrive.

Events of a path wait in its state until the watermark has passed them, so that all earlier ones are there; then they
join the run that is open, or close it and begin another. A run is closed once the watermark has passed its last event by
the gap. A path has one timer, the earliest that it needs, so calls follow paths and batches, not events. Events behind the watermark when they come are late: Spark drops them before the state and counts them,
``late_events`` tells how many. State holds a path's open run and the events of the watermark's delay, and goes when both
are gone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

OUT = "path string, type string, ts timestamp, merged long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EVENT = "micros long, seq long, type string"


class _Runs(StatefulProcessor):
    def __init__(self, gap_micros: int):
        self.gap = gap_micros

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _EVENT)
        self.run = handle.getValueState("run", "type string, micros long, merged long")
        self.due = handle.getValueState("due", "millis long")

    def _wake(self, millis: int) -> None:
        """One timer for a path: the earliest that its state wants."""
        due = self.due.get()
        if due and due[0] <= millis:
            return
        if due:
            self.handle.deleteTimer(due[0])
        self.handle.registerTimer(millis)
        self.due.update((millis,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = [e for some in rows for e in zip(some["micros"].tolist(), some["seq"].tolist(), some["type"].tolist(), strict=True)]
        if events:
            self.waiting.appendList(events)
            self._wake(min(e[0] for e in events) // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = list(self.waiting.get())
        ready = sorted(e for e in held if e[0] < passed)
        rest = [e for e in held if e[0] >= passed]
        before = run = self.run.get()
        out = []
        for micros, _, kind in ready:
            if run and micros - run[1] >= self.gap:
                out.append(run)
                run = None
            run = (kind, micros, (run[2] if run else 0) + 1)
        if run and run[1] + self.gap < passed:
            out.append(run)
            run = None
        if ready:
            self.waiting.put(rest) if rest else self.waiting.clear()
        if run:
            self.run.update(run)
        elif before:
            self.run.clear()
        self.due.clear()
        wanted = [e[0] // 1000 + 1 for e in rest] + ([(run[1] + self.gap) // 1000 + 1] if run else [])
        if wanted:
            self._wake(min(wanted))
        if out:
            kinds, micros, merged = zip(*out, strict=True)
            yield pd.DataFrame({"path": key[0], "type": kinds, "ts": pd.to_datetime(micros, unit="us", utc=True), "merged": merged})

    def close(self) -> None:
        pass


def debounce_timers(events: DataFrame, gap_seconds: float, watermark: str = "10 seconds") -> DataFrame:
    """A stream of (path, type, ts, seq) to (path, type, ts, merged): a row for each run once it is over. The session must
    use the state store ``PROVIDER``."""
    from pyspark.sql import functions as F

    rows = events.withWatermark("ts", watermark).select("path", "type", "seq", F.unix_micros("ts").alias("micros"), "ts")
    return rows.groupBy("path").transformWithStateInPandas(_Runs(round(gap_seconds * 1e6)), OUT, "Append", "EventTime")


def late_events(query) -> int:
    """Events that a running or finished query dropped because they came behind the watermark."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
