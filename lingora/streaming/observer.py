"""Streams: debounced sessions, a result cache with a time to live, suppression of echoes of own writes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType
from pyspark.sql.window import Window

from lingora.operators.folds import in_order


def debounce(events: DataFrame, keys: list[str], gap: str, watermark: str | None = None) -> DataFrame:
    """(keys, start, last, n): bursts that `gap` without an event ends; for tables and, with a watermark, for streams."""
    if watermark:
        events = events.withWatermark("ts", watermark)
    found = events.groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return found.select(*keys, F.col("w.start").alias("start"), "last", "n")


def incremental(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """A stream's events without those that repeat an id within the watermark."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])


def ttl_hits(requests: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """requests (keys, ts, seq) with hit: a value set at most `seconds` ago; a hit does not renew it.

    The last set before a request decides, and that depends on all requests before: a fold over each key's requests in
    order, of which a task holds the time of the last set and one batch. Streams keep that time in state (cached_stream).
    """
    limit = seconds * 1_000_000

    def step(held, at):
        hit = held is not None and at is not None and at - held <= limit
        return (held if hit else at), hit

    rows = requests.select(*keys, "ts", "seq")
    return in_order(rows, keys, ["ts", "seq"], [F.unix_micros(F.col("ts").cast("timestamp"))], "hit", BooleanType(), step)


def suppressed(changes: DataFrame, writes: DataFrame, key: str, millis: int = 500) -> DataFrame:
    """Changes (key, ts) that are not within `millis` after an own write (key, ts): the last write before each decides."""
    both = changes.select(key, "ts", F.lit(1).alias("kind")).unionByName(writes.select(key, "ts", F.lit(0).alias("kind")))
    before = Window.partitionBy(key).orderBy("ts", "kind").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("kind") == 0, F.col("ts")), ignorenulls=True).over(before)
    age = F.unix_millis(F.col("ts").cast("timestamp")) - F.unix_millis(last.cast("timestamp"))
    return both.withColumn("age", age).where(f"kind = 1 AND (age IS NULL OR age > {millis})").select(key, "ts")


class LruCache:
    """A least-recently-used cache with a time to live counted from the set; the sequential twin of the stream operator."""

    def __init__(self, capacity: int = 1000, ttl_ms: int = 300_000) -> None:
        self.capacity, self.ttl, self.items = capacity, ttl_ms, {}

    def get(self, key, now: int):
        held = self.items.get(key)
        if held is None:
            return None
        if now - held[1] > self.ttl:
            del self.items[key]
            return None
        self.items[key] = self.items.pop(key)
        return held[0]

    def set(self, key, value, now: int) -> None:
        if len(self.items) >= self.capacity:
            del self.items[next(iter(self.items))]
        self.items[key] = (value, now)


def replay_cache(ops: DataFrame, group: str, capacity: int = 1000, ttl_ms: int = 300_000) -> DataFrame:
    """ops (group, seq, ts_ms, op, key, value) with what each get found; the cache is one to a group."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        cache, out = LruCache(capacity, ttl_ms), []
        for r in frame.sort_values("seq").itertuples():
            found = cache.get(r.key, r.ts_ms) if r.op == "get" else cache.set(r.key, r.value, r.ts_ms)
            out.append((getattr(r, group), r.seq, r.op, r.key, found))
        return pd.DataFrame(out, columns=[group, "seq", "op", "key", "found"])

    kind = ops.schema[group].dataType.simpleString()
    return ops.groupBy(group).applyInPandas(run, f"{group} {kind}, seq int, op string, key string, found string")


def cached_stream(requests: DataFrame, key: str, seconds: int, watermark: str = "10 minutes") -> DataFrame:
    """A stream of requests (key, ts) with hit; state is the time of the last set of a key."""

    def run(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else None
        for frame in frames:
            hits = []
            for ts in frame.sort_values("ts").ts:
                now = pd.Timestamp(ts).value // 1000
                hit = held is not None and now - held <= seconds * 1_000_000
                held = held if hit else now
                hits.append((k[0], ts, hit))
            yield pd.DataFrame(hits, columns=[key, "ts", "hit"])
        state.update((held,))

    kind = requests.schema[key].dataType.simpleString()
    stream = requests.withWatermark("ts", watermark).groupBy(key)
    return stream.applyInPandasWithState(run, f"{key} {kind}, ts timestamp, hit boolean", "held long", "append", "NoTimeout")
