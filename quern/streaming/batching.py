"""Requests in batches of at most so many, each dispatched when it is full or its first request has waited so long."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

MOST, WAIT_MS = 16, 20
OUT = "key long, batch long, ids array<long>, first_ms long, dispatched_ms long, full boolean"


class Batcher(StatefulProcessor):
    """The open batch of each key is a list of (id, ts_ms); a timer at its first request's time and the wait ends it. Times
    are those of the requests, so what is dispatched doesn't depend on how they reach the query."""

    def __init__(self, most: int = MOST, wait_ms: int = WAIT_MS):
        self.most, self.wait = most, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "id long, ts_ms long")
        self.number = handle.getValueState("number", "n long")

    def _out(self, key: tuple, batches: list[tuple[list[tuple], int, bool]]) -> pd.DataFrame:
        """Rows of dispatched batches (requests, time, full): the number is read and kept once for all of them."""
        n = self.number.get()[0] if self.number.exists() else 0
        self.number.update((n + len(batches),))
        ids, firsts = [[i for i, _ in rows] for rows, _, _ in batches], [rows[0][1] for rows, _, _ in batches]
        return pd.DataFrame({"key": [key[0]] * len(batches), "batch": range(n, n + len(batches)), "ids": ids, "first_ms": firsts, "dispatched_ms": [at for _, at, _ in batches], "full": [full for _, _, full in batches]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [(r[0], r[1]) for r in self.open.get()] if self.open.exists() else []
        began, gone = held[0][1] if held else None, []
        fresh = pd.concat(list(rows)).sort_values(["ts_ms", "id"])
        for i, t in zip(fresh["id"].tolist(), fresh["ts_ms"].tolist(), strict=True):
            if held and t >= held[0][1] + self.wait:
                gone.append((held, held[0][1] + self.wait, False))
                held = []
            held.append((i, t))
            if len(held) == self.most:
                gone.append((held, t, True))
                held = []
        if began is not None and (not held or held[0][1] != began):
            self.handle.deleteTimer(began + self.wait)
        if held:
            self.open.put(held)
            self.handle.registerTimer(held[0][1] + self.wait)
        else:
            self.open.clear()
        if gone:
            yield self._out(key, gone)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [(r[0], r[1]) for r in self.open.get()] if self.open.exists() else []
        if held and held[0][1] + self.wait <= expiredTimerInfo.getExpiryTimeInMs():
            self.open.clear()
            yield self._out(key, [(held, held[0][1] + self.wait, False)])


#: Fixed value: the store that state of lists and timers needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def batched(requests: DataFrame, most: int = MOST, wait_ms: int = WAIT_MS, late: str = "0 seconds") -> DataFrame:
    """key, batch (from 0), ids, first_ms, dispatched_ms and full of the batches of a stream of requests (key, id, ts_ms). A
    key's requests of one trigger are taken in order of time; timers follow the watermark."""
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    timed = requests.withColumn("time", F.timestamp_millis("ts_ms")).withWatermark("time", late)
    return timed.groupBy("key").transformWithStateInPandas(Batcher(most, wait_ms), OUT, "Append", "EventTime")
