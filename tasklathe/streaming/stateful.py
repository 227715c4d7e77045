"""Keyed state with timers: leases that end unless a heartbeat extends them, and signal inboxes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EXPIRED = "run_id string, lease_ends timestamp"
RECEIVED = "task_id string, signal_name string, payload string"


#: How long a run that is over is remembered, so that nothing revives it.
OVER_KEPT_MS = 86_400_000


class LeaseTimers(StatefulProcessor):
    """One lease a run: a row with an end sets it, one without ends the run; at a lease's end the run is told, and over.

    Rows count by their time, in whatever micro-batch they come: an older one
    changes nothing, and nothing revives a run that is over.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "ends long, seen long, over boolean")

    def _set(self, ends: int, seen: int, over: bool) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.lease.update((ends, seen, over))
        self.handle.registerTimer(ends + OVER_KEPT_MS if over else ends)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ends, seen, over = self.lease.get() if self.lease.exists() else (0, None, False)
        told = pd.concat(list(rows)).sort_values("ts")
        millis = lambda at: int(at.timestamp() * 1000)
        if over:
            return iter([])
        stops = told[told["lease_ends"].isna()]
        if len(stops):
            self._set(millis(stops.iloc[0]["ts"]), millis(stops.iloc[0]["ts"]), True)
        elif seen is None or millis(told.iloc[-1]["ts"]) >= seen:
            self._set(millis(told.iloc[-1]["lease_ends"]), millis(told.iloc[-1]["ts"]), False)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.lease.exists():
            return
        ends, seen, over = self.lease.get()
        if over:
            self.lease.clear()
        elif ends <= expiredTimerInfo.getExpiryTimeInMs():
            self._set(ends, seen, True)
            yield pd.DataFrame({"run_id": [key[0]], "lease_ends": [pd.Timestamp(ends, unit="ms")]})

    def close(self) -> None:
        pass


def expired_lease_stream(leases: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Runs whose lease ends before event time passes it.

    leases has ``run_id``, ``ts`` and ``lease_ends`` (null when the run is over).
    The session's state store must be RocksDB.
    """
    timed = leases.withWatermark("ts", delay)
    return timed.groupBy("run_id").transformWithStateInPandas(LeaseTimers(), EXPIRED, "Append", "EventTime")


class SignalInbox(StatefulProcessor):
    """Per task, signals in order; a receive of a name takes the oldest of that name and leaves the others.

    A receive that finds none waits for the next signal of its name.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "signal_name string, payload string")
        self.receives = handle.getListState("receives", "signal_name string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        asked = [x[0] for x in self.receives.get()] if self.receives.exists() else []
        out = []
        for row in pd.concat(list(rows)).sort_values("seq").itertuples():
            if row.kind == "send":
                if row.signal_name in asked:
                    asked.remove(row.signal_name)
                    out.append((key[0], row.signal_name, row.payload))
                else:
                    held.append((row.signal_name, row.payload))
                continue
            at = next((i for i, (name, _) in enumerate(held) if name == row.signal_name), None)
            if at is not None:
                out.append((key[0], *held.pop(at)))
            else:
                asked.append(row.signal_name)
        for state, kept in ((self.waiting, held), (self.receives, [(name,) for name in asked])):
            if kept:
                state.put(kept)
            else:
                state.clear()
        yield pd.DataFrame(out, columns=["task_id", "signal_name", "payload"])

    def close(self) -> None:
        pass


def received_signals(actions: DataFrame) -> DataFrame:
    """What receives get: actions have ``task_id``, ``seq``, ``kind`` (send or receive), ``signal_name``, ``payload``."""
    return actions.groupBy("task_id").transformWithStateInPandas(SignalInbox(), RECEIVED, "Append", "None")
