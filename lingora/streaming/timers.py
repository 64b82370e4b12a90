"""Streams with event-time timers: bursts with the set that waits in them, and changes that are not echoes of own writes.

Both keep rows of a key in a list in the state store and let a timer of the watermark decide, so rows may arrive in any order
within the watermark's delay and the result is that of the table. State of a key is what the delay and the gap hold of
it. The session's state store has to be RocksDB (STORE): the operator that has timers asks for it.

Defined results: rows with a null time are dropped; rows with a null key form a key; rows later than the watermark are
dropped, as by any other stateful operator; a burst or a change is returned when the watermark has passed its end, so
the last ones of a stream stay in state until later rows of any key arrive.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _micros(ts: pd.Series) -> list[int]:
    return ts.to_numpy().astype("datetime64[us]").astype("int64").tolist()


def _timer(micros: int) -> int:
    """The first millisecond that is not before."""
    return -(-micros // 1000)


class Bursts(StatefulProcessor):
    """Open bursts of a key: (start, last, n, items). Each row that arrives sets the timer of its burst anew."""

    def __init__(self, key: str, gap: int) -> None:
        self.key, self.gap = key, gap * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "start long, last long, n long, items array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = [(r[0], r[1], r[2], set(r[3])) for r in self.open.get()]
        before = {_timer(last + self.gap) for _, last, _, _ in known}
        for frame in rows:
            frame = frame[frame.ts.notna()]
            known += [(t, t, 1, {i} if isinstance(i, str) else set()) for t, i in zip(_micros(frame.ts), frame["item"])]
        merged: list[tuple] = []
        for start, last, n, items in sorted(known, key=lambda b: b[:2]):
            if merged and start - merged[-1][1] < self.gap:
                a = merged.pop()
                merged.append((a[0], max(a[1], last), a[2] + n, a[3] | items))
            else:
                merged.append((start, last, n, items))
        after = {_timer(last + self.gap) for _, last, _, _ in merged}
        for t in before - after:
            self.handle.deleteTimer(t)
        for t in after - before:
            self.handle.registerTimer(t)
        if merged:
            self.open.put([(a, b, n, sorted(items)) for a, b, n, items in merged])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        known = [(r[0], r[1], r[2], list(r[3])) for r in self.open.get()]
        rest = [b for b in known if b[1] + self.gap > now]
        if rest:
            self.open.put(rest)
        else:
            self.open.clear()
        done = [b for b in known if b[1] + self.gap <= now]
        yield _frame({self.key: [key[0]] * len(done), "start": [b[0] for b in done], "last": [b[1] for b in done], "n": [b[2] for b in done], "items": [b[3] for b in done]}, ("start", "last"))


def _frame(columns: dict, times: tuple[str, ...]) -> pd.DataFrame:
    return pd.DataFrame({c: pd.to_datetime(pd.Series(v, dtype="int64"), unit="us") if c in times else pd.Series(v, dtype=object) for c, v in columns.items()})


class Echoes(StatefulProcessor):
    """Changes that wait for the watermark and the writes that may still explain one of them: (ts, kind)."""

    def __init__(self, key: str, hold: int) -> None:
        self.key, self.hold = key, hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "ts long, change boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = [x for frame in rows for x in zip(_micros(frame.ts[frame.ts.notna()]), frame.change[frame.ts.notna()].tolist())]
        for t in {_timer(t) for t, change in fresh if change}:
            self.handle.registerTimer(t)
        if fresh:
            self.held.appendList([(t, bool(c)) for t, c in fresh])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        known = sorted((r[0], r[1]) for r in self.held.get())
        out, last = [], None
        for t, change in known:  # at equal times a write (False) comes first
            if not change:
                last = t
            elif t <= now and (last is None or t // 1000 - last // 1000 > self.hold):
                out.append(t)
        # The watermark has passed now, so no change at or before it can come any more.
        rest = [(t, c) for t, c in known if (t > now if c else t >= now - (self.hold + 1) * 1000)]
        if rest:
            self.held.put(rest)
        else:
            self.held.clear()
        yield _frame({self.key: [key[0]] * len(out), "ts": out}, ("ts",))


def debounced(events: DataFrame, key: str, item: str, gap: int, watermark: str) -> DataFrame:
    """(key, start, last, n, items): bursts of a stream's events (key, item, ts) that `gap` milliseconds of quiet end, with their set of items."""
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(key, F.col(item).cast("string").alias("item"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", watermark)
    schema = f"{key} {kind}, start timestamp, last timestamp, n long, items array<string>"
    return rows.groupBy(key).transformWithStateInPandas(Bursts(key, gap), schema, "append", "EventTime")


def bursts(events: DataFrame, key: str, item: str, gap: int) -> DataFrame:
    """debounced() of a table. Sessions that touch would merge, so they are shorter by the least difference of two times."""
    found = events.where("ts IS NOT NULL").groupBy(key, F.session_window("ts", f"{gap * 1000 - 1} microseconds").alias("w"))
    sets = found.agg(F.max("ts").alias("last"), F.count("*").alias("n"), F.array_sort(F.collect_set(F.col(item).cast("string"))).alias("items"))
    return sets.select(key, F.col("w.start").alias("start"), "last", "n", "items")


def unechoed(changes: DataFrame, writes: DataFrame, key: str, hold: int, watermark: str) -> DataFrame:
    """(key, ts) of a stream's changes that are not within `hold` milliseconds after an own write of their key; suppressed() as a stream."""
    kind = changes.schema[key].dataType.simpleString()
    ts = F.col("ts").cast("timestamp").alias("ts")
    both = changes.select(key, ts, F.lit(True).alias("change")).unionByName(writes.select(key, ts, F.lit(False).alias("change")))
    return both.withWatermark("ts", watermark).groupBy(key).transformWithStateInPandas(Echoes(key, hold), f"{key} {kind}, ts timestamp", "append", "EventTime")
