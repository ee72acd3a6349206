"""The track builder as a stateful stream: open tracks as list state, idle videos closed by timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.tracking import MISSES, OUT, REACH, TOP, Tracker, best_first
from ..operators.tracking import rows as track_rows

_OPEN = "x double, y double, miss int, t0 double, t1 double, t_best double, bx int, by int, bw int, bh int, score double"
_HELD = "t double, dx double, dy double, blobs array<struct<x: int, y: int, w: int, h: int, score: double>>"
#: What a stream may start from: a row for each open track, with the video's last sample and the number of its closed tracks.
INITIAL = f"video string, last_t double, closed long, {_OPEN}"


class _Tracks(StatefulProcessor):
    """One video: its clock (time of the last sample fed, of the newest one seen, tracks closed), open tracks, and samples that wait for earlier ones."""

    def __init__(self, reach: float, misses: int, top: int, late: float, idle_ms: int | None):
        self.how, self.top, self.late, self.idle_ms = (reach, misses), top, late, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "fed double, seen double, closed long")
        self.open = handle.getListState("open", _OPEN)
        self.held = handle.getListState("held", _HELD)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: TimerValues) -> None:
        some = initialState[initialState.t0.notna()]
        self.open.appendList([tuple(r) for r in some[_OPEN.replace(",", "").split()[::2]].itertuples(index=False)])
        first = initialState.iloc[0]
        self.clock.update((float(first.last_t), float(first.last_t), int(first.closed)))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        fed, seen, closed = self.clock.get() or (float("-inf"), float("-inf"), 0)
        new, ended = [], False
        for p in rows:
            ended |= bool(p["t"].isna().any())
            own = p[p["t"] > fed]
            new += list(zip(own["t"], own["dx"], own["dy"], own["blobs"], strict=True))
        seen = max([seen, *(r[0] for r in new)])
        ready = sorted([*self.held.get(), *new], key=lambda r: r[0])
        wait = [] if ended else [r for r in ready if r[0] > seen - self.late]
        tracker = Tracker(*self.how)
        tracker.restore([list(t) for t in self.open.get()])
        done = []
        for t, dx, dy, found in ready[: len(ready) - len(wait)]:
            if t > fed:
                fed = t
                done += tracker.feed(t, dx, dy, best_first([b if isinstance(b, dict) else b.asDict() for b in found] if found is not None else None, self.top))
        if ended:
            done += tracker.open
            self._forget()
        else:
            self._put(self.open, [tuple(s) for s in tracker.state()])
            self._put(self.held, [(float(t), float(dx), float(dy), [tuple(b[c] for c in ("x", "y", "w", "h", "score")) for b in found] if found is not None else None) for t, dx, dy, found in wait])
            self.clock.update((float(fed), float(seen), closed + len(done)))
            self._wake(timerValues)
        yield track_rows(key[0], done, closed).rename(columns={"closed": "track"})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The video has ended: what waits is fed, and what is open closes."""
        yield from self.handleInputRows(key, iter([pd.DataFrame({"t": [None], "dx": [None], "dy": [None], "blobs": [None]})]), timerValues)

    def _forget(self) -> None:
        for state in (self.clock, self.open, self.held):
            state.clear()

    @staticmethod
    def _put(state, values: list) -> None:
        if values:
            state.put(values)
        else:
            state.clear()

    def _wake(self, timers: TimerValues) -> None:
        if self.idle_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle_ms)


def stream_tracks(samples: DataFrame, reach: float = REACH, misses: int = MISSES, top: int = TOP, late: float = 0.0, idle_ms: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """Tracks as they close, from a stream of (video, t, dx, dy, blobs); `track` numbers those of a video in closing order.

    Samples may come up to `late` seconds after later ones and are fed in order of time all the same; what comes after its turn, or
    twice, is left out. A row without t ends its video: all its tracks close and its state goes. So does, if idle_ms is given, a video
    without a sample for so long. initial: rows of INITIAL, from which the stream goes on. The session needs a
    RocksDB state store, which session.session() sets.
    """
    groups = None if initial is None else initial.groupBy("video")
    own = samples.select("video", "t", "dx", "dy", "blobs")
    return own.groupBy("video").transformWithStateInPandas(_Tracks(reach, misses, top, late, idle_ms), OUT, "append", "none" if idle_ms is None else "processingTime", groups)
