"""Structured Streaming: keyed limits and quotas, usage sinks, windows with watermarks, shuffle buffers."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


#: Times without requests after which queries that run on may forget a key's state, or a day's. They are waited for, so a
#: query that ends by itself (trigger availableNow) takes none.
IDLE_MS, IDLE_DAYS_MS = 3_600_000, 2 * 86_400_000


def _timeout(idle_ms: int | None) -> str:
    return GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def limited(requests: DataFrame, limit: int, window_ms: int = 60_000, idle_ms: int | None = None) -> DataFrame:
    """requests(key, id, ts_ms) with allowed: an admitted request lies in the window; the state is at most limit times a key,
    and with idle_ms it is gone after so long without a request.

    Within a batch a key's requests are replayed by time; order across batches is that of arrival.
    """

    def each(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = deque(state.get[0] if state.exists else ())
        rows = pd.concat(list(frames)).sort_values(["ts_ms", "id"])
        allowed = []
        for t in rows["ts_ms"].tolist():
            while kept and kept[0] <= t - window_ms:
                kept.popleft()
            ok = len(kept) < limit
            if ok:
                kept.append(t)
            allowed.append(ok)
        state.update((list(kept),))
        if idle_ms is not None:
            state.setTimeoutDuration(max(idle_ms, window_ms))
        yield pd.DataFrame({"key": rows["key"], "id": rows["id"], "ts_ms": rows["ts_ms"], "allowed": allowed})

    return requests.groupBy("key").applyInPandasWithState(each, "key long, id long, ts_ms long, allowed boolean", "kept array<long>", "append", _timeout(idle_ms))


def quota(usage: DataFrame, per_day: int, idle_ms: int | None = None) -> DataFrame:
    """usage(org_id, day, id, tokens) with allowed: tokens of admitted requests count until the day's quota is used. With
    idle_ms a day's counter is gone after so long without a request."""

    def each(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values("id")
        allowed = []
        for n in rows["tokens"].tolist():
            ok = used < per_day
            used += n if ok else 0
            allowed.append(ok)
        state.update((used,))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield rows[["org_id", "day", "id", "tokens"]].assign(allowed=allowed)

    return usage.groupBy("org_id", "day").applyInPandasWithState(each, "org_id long, day string, id long, tokens long, allowed boolean", "used long", "append", _timeout(idle_ms))


def windowed(events: DataFrame, size: str = "1 day", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums of events(ts, event_type, value) by window; rows later than the watermark are left out."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("start"), "n")


def once(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """The first of rows with one key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def usage_sink(records: str, totals: str):
    """For foreachBatch: append a batch's records and its sums by org and day, each under the batch's number, so that a
    replayed batch overwrites itself."""

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{records}/batch={number}")
        sums = batch.groupBy("org_id", F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.sum("total_tokens").alias("total_tokens"), F.count("*").alias("requests"))
        sums.write.mode("overwrite").parquet(f"{totals}/batch={number}")

    return each


def event_log(stream: DataFrame, folder: str, checkpoint: str):
    """A query that appends each event as a JSON line below folder, once however often a batch is replayed."""
    return stream.writeStream.format("json").outputMode("append").option("checkpointLocation", checkpoint).start(folder)


def shuffled(rows: DataFrame, buffer: int = 1_000, seed: int = 1) -> DataFrame:
    """rows of each partition in the order of a shuffle buffer: fill, shuffle, emit nine tenths."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for f in frames:
            held = f if held is None else pd.concat([held, f])
            while len(held) >= buffer:
                mixed = held.iloc[:buffer].sample(frac=1, random_state=seed)
                yield mixed.iloc[: buffer * 9 // 10]
                held = pd.concat([mixed.iloc[buffer * 9 // 10 :], held.iloc[buffer:]])
        if held is not None and len(held):
            yield held.sample(frac=1, random_state=seed)

    return rows.mapInPandas(each, rows.schema)
