"""Run states in event time: rows wait in state until the watermark passes them, so their order of arrival does not matter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagelode.operators.eventlog import ALLOWED

#: State kept by key, list and timer needs this store; the session must name it before the query starts.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "run_id string, us long, from_state string, to_state string, legal boolean, elapsed_ms long"


def up(us: int) -> int:
    """Microseconds as whole milliseconds, rounded up."""
    return -(-us // 1000)


class Steps(StatefulProcessor):
    """Steps of one run: the last state and the start as a value, rows the watermark has not passed as a list."""

    def __init__(self, allowed: dict[str, list[str]]):
        self.allowed = allowed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "state string, started long")
        self.waiting = handle.getListState("waiting", "us long, state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed, first = timerValues.getCurrentWatermarkInMs(), None
        for batch in rows:
            new = [(int(us), state) for us, state in zip(batch["us"], batch["state"]) if up(int(us)) > passed]
            if new:
                self.waiting.appendList(new)
                first = min(new)[0] if first is None else min(first, min(new)[0])
        if first is not None:
            self.handle.registerTimer(up(first))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = sorted((us, state) for us, state in self.waiting.get())
        due = [h for h in held if up(h[0]) <= passed]
        if not due:
            return
        if len(due) < len(held):
            self.waiting.put(held[len(due):])
            self.handle.registerTimer(up(held[len(due)][0]))
        else:
            self.waiting.clear()
        current, started = self.last.get() if self.last.exists() else (None, due[0][0])
        out = []
        for us, to in due:
            out.append((key[0], us, current, to, current is None or current == to or to in self.allowed.get(current, []), us // 1000 - started // 1000))
            current = to
        self.last.update((current, started))
        yield pd.DataFrame(out, columns=["run_id", "us", "from_state", "to_state", "legal", "elapsed_ms"])

    def close(self) -> None:
        pass


def run_steps_stream(events: DataFrame, delay: str, allowed: dict[str, list[str]] | None = None) -> DataFrame:
    """Steps of runs(run_id, ts, state) in order of ts, then state: (run_id, ts, from_state, to_state, legal, elapsed_ms).

    A step appears once the watermark has passed its row; rows behind the watermark, and rows with
    a NULL in one of the three columns, are left out. So the stream gives the rows of the batch
    over all other events, in whatever order and triggers they came. What a run holds is the rows
    of the last `delay`. Needs `spark.sql.streaming.stateStore.providerClass` set to STORE.
    """
    rows = events.select("run_id", "ts", "state").na.drop().withWatermark("ts", delay).withColumn("us", F.unix_micros("ts"))
    found = rows.groupBy("run_id").transformWithStateInPandas(Steps(ALLOWED if allowed is None else allowed), OUT, "Append", "EventTime")
    return found.select("run_id", F.timestamp_micros("us").alias("ts"), "from_state", "to_state", "legal", "elapsed_ms")
