"""Searches as a stream of visited states: each state of an item once, and an end after a time.

The state that is kept is an item's begin and the states that it has seen. A timer ends the item; its state goes then, and what still comes
in for it later is told apart as late.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "item long, state long, what string, at timestamp, n_seen long"
#: The state store that timers and maps need.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class _Visits(StatefulProcessor):
    """Rows come by item; times are milliseconds of the rows, and the clock is the stream's watermark."""

    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.begun = handle.getValueState("begun", "at long, n long, over boolean")
        self.seen = handle.getMapState("seen", "state long", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for frame in rows:
            for state, at in sorted(zip(frame["state"], frame["at"], strict=True), key=lambda r: (r[1], r[0])):
                ms = int(at.value // 1_000_000)
                now = self.begun.get() if self.begun.exists() else None
                if now is None:
                    now = (ms, 0, False)
                    self.handle.registerTimer(ms + self.limit_ms)
                begin, n, over = now
                if over or ms - begin > self.limit_ms:
                    out.append((key[0], state, "late", at, n))
                elif self.seen.containsKey((int(state),)):
                    (m,) = self.seen.getValue((int(state),))
                    self.seen.updateValue((int(state),), (m + 1,))
                else:
                    n += 1
                    self.seen.updateValue((int(state),), (1,))
                    out.append((key[0], state, "new", at, n))
                self.begun.update((begin, n, over))
        yield pd.DataFrame(out, columns=["item", "state", "what", "at", "n_seen"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        begin, n, _ = self.begun.get()
        self.seen.clear()
        self.begun.update((begin, n, True))
        at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        yield pd.DataFrame([(key[0], None, "timeout", at, n)], columns=["item", "state", "what", "at", "n_seen"]).astype({"state": "Int64"})

    def close(self) -> None:
        pass


def visits(rows: DataFrame, limit_s: float, delay: str = "0 seconds") -> DataFrame:
    """item, state, what, at, n_seen of a stream of item, state and at: ``new`` for the first visit of a state, ``timeout`` when ``limit_s`` seconds have passed since an item's first row, ``late`` for what comes in after that.

    The clock is the stream's own: it stands at the latest ``at`` less ``delay``. Later visits of a state give nothing. Set ``STORE`` in the
    session. Rows with a null item, state or time are left out; equal rows are one visit.
    """
    known = rows.select(F.col("item").cast("long").alias("item"), F.col("state").cast("long").alias("state"), F.col("at").cast("timestamp").alias("at")).where("item is not null and state is not null and at is not null")
    return known.withWatermark("at", delay).groupBy("item").transformWithStateInPandas(_Visits(round(limit_s * 1000)), OUT, "append", "eventtime")
