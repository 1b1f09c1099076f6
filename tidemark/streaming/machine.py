"""A keyed state machine over a stream, by Spark's state-store API.

Each key's edits are staged, applied and undone: an edit may be staged where none is open, applied where one is staged, undone
where one is applied. Whatever else comes is refused and counted by its kind. A staged edit that nothing follows for
`patience` of event time expires by a timer. State is one value (the machine), one list (edits applied so far, newest last) and
one map (refusals by kind); it needs the RocksDB state store, which `with_states` sets where the session has another.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "key bigint, state string, applied bigint, refused bigint, refusals string, n bigint"
MACHINE = "state string, edit bigint, due bigint, refused bigint, n bigint"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NONE, STAGED, APPLIED, UNDONE, EXPIRED = "none", "staged", "applied", "undone", "expired"
#: What each action asks of the state and makes of it.
MOVES = {"stage": ((NONE, UNDONE, EXPIRED, APPLIED), STAGED), "apply": ((STAGED,), APPLIED), "undo": ((APPLIED,), UNDONE)}


class Edits(StatefulProcessor):
    """Rows (key, edit, action, at) in the order of at, then edit, within a batch."""

    def __init__(self, patience_ms: int | None):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.machine = handle.getValueState("machine", MACHINE)
        self.done = handle.getListState("done", "edit bigint")
        self.refusals = handle.getMapState("refusals", "kind string", "n bigint")

    def _row(self, key: Any, state: tuple) -> Any:
        import pandas as pd

        done = [int(x[0]) for x in self.done.get()]
        kinds = ",".join(f"{k[0]}:{v[0]}" for k, v in sorted(self.refusals.iterator()))
        return pd.DataFrame({"key": [key[0]], "state": [state[0]], "applied": [len(done)], "refused": [state[3]], "refusals": [kinds], "n": [state[4]]})

    def handleInputRows(self, key: Any, rows: Iterator[Any], timerValues: Any) -> Iterator[Any]:
        import pandas as pd

        state, edit, due, refused, n = self.machine.get() if self.machine.exists() else (NONE, None, None, 0, 0)
        batch = pd.concat(list(rows)).sort_values(["at", "edit"])
        done = [int(x[0]) for x in self.done.get()]
        for row in batch.itertuples():
            n += 1
            wanted, then = MOVES.get(row.action, ((), None))
            at = int(row.at.value // 1_000_000)
            if state == STAGED and due is not None and at >= due:
                state, due = EXPIRED, self._disarm(due)  # a row of a later time came before the timer
            if state not in wanted:
                refused += 1
                kind = (str(row.action),)
                self.refusals.updateValue(kind, ((self.refusals.getValue(kind)[0] if self.refusals.containsKey(kind) else 0) + 1,))
                continue
            state, due = then, self._disarm(due)
            if then == STAGED:
                edit = int(row.edit)
                if self.patience is not None:
                    due = at + self.patience
                    self.handle.registerTimer(due)
            elif then == APPLIED:
                done.append(edit)
            elif then == UNDONE:
                done.pop()
        self.done.put([(x,) for x in done]) if done else self.done.clear()
        self.machine.update((state, edit, due, refused, n))
        yield self._row(key, (state, edit, due, refused, n))

    def _disarm(self, due: int | None) -> None:
        if due is not None:
            self.handle.deleteTimer(due)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Any]:
        state, edit, due, refused, n = self.machine.get()
        if state == STAGED and due is not None and expiredTimerInfo.getExpiryTimeInMs() >= due:
            state = EXPIRED
            self.machine.update((state, edit, None, refused, n))
            yield self._row(key, (state, edit, None, refused, n))

    def close(self) -> None:
        pass


def with_states(spark: SparkSession) -> SparkSession:
    setting = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(setting, "") != PROVIDER:
        spark.conf.set(setting, PROVIDER)
    return spark


def edits(rows: DataFrame, patience_ms: int | None = None, late: str = "1 hour") -> DataFrame:
    """(key, state, applied, refused, refusals, n) after each batch of a stream (key, edit, action, at), and when a timer fires."""
    with_states(rows.sparkSession)
    timed = rows.withWatermark("at", late).groupBy("key")
    return timed.transformWithStateInPandas(Edits(patience_ms), OUTPUT, "Update", "EventTime")
