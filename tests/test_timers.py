import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lingora.streaming import observer as O
from lingora.streaming import timers

T0 = datetime(2024, 1, 1)
SCHEMA = "file int, k string, item string, ts timestamp"


@pytest.fixture
def rocks(spark):
    before = {k: spark.conf.get(k, None) for k in timers.STORE}
    for k, v in timers.STORE.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def events(n, files, seed):
    """Events of five keys over some minutes; a file may bring those of the last 20 seconds late; the last file ends it all."""
    rng = random.Random(seed)
    at = sorted((rng.randrange(0, 240_000), rng.choice("abcde")) for _ in range(n))
    rows = [(min(files - 1, (t + rng.randrange(0, 15_000)) // (255_000 // files)), k, rng.choice("xyz"), T0 + timedelta(microseconds=t * 1000 + rng.choice([0, 0, 1, 999]))) for t, k in at]
    return rows, [(files, "end", "e", T0 + timedelta(hours=1)), (files + 1, "end", "e", T0 + timedelta(hours=2))]


def streamed(spark, at, rows):
    for i in sorted({r[0] for r in rows}):
        spark.createDataFrame([r for r in rows if r[0] == i], SCHEMA).coalesce(1).write.mode("append").parquet(at)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(at)


def collected(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


def test_debounced_stream_equals_the_table(rocks, tmp_path):
    rows, end = events(160, 6, 1)
    stream = streamed(rocks, str(tmp_path / "in"), rows + end)
    got = collected(timers.debounced(stream, "k", "item", 3000, "30 seconds"), "debounced").where("k <> 'end'")
    want = timers.bursts(rocks.createDataFrame(rows, SCHEMA), "k", "item", 3000)
    listed = lambda df: sorted((r.k, r.start, r.last, r.n, tuple(sorted(r["items"]))) for r in df.collect())
    assert len(listed(want)) > 40 and listed(got) == listed(want)


def test_suppressed_stream_equals_the_table(rocks, tmp_path):
    rows, end = events(160, 6, 2)
    stream = streamed(rocks, str(tmp_path / "in"), rows + end)
    parts = lambda df: (df.where("item <> 'x'").select("k", "ts"), df.where("item = 'x'").select("k", "ts"))
    got = collected(timers.unechoed(*parts(stream), "k", 2000, "30 seconds"), "unechoed").where("k <> 'end'")
    want = O.suppressed(*parts(rocks.createDataFrame(rows, SCHEMA)), "k", 2000)
    listed = lambda df: sorted((r.k, r.ts) for r in df.collect())
    assert 0 < len(listed(want)) < 120 and listed(got) == listed(want)


def test_bursts_of_a_table(spark):
    rows = [(0, "a", "p", T0), (0, "a", "q", T0 + timedelta(milliseconds=299)), (0, "a", "p", T0 + timedelta(milliseconds=599)), (0, "a", None, T0 + timedelta(seconds=9)), (0, None, "r", T0), (0, "b", "s", None)]
    got = timers.bursts(spark.createDataFrame(rows, SCHEMA), "k", "item", 300).select("k", "n", F.array_join("items", "").alias("i")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([("a", 2, "pq"), ("a", 1, "p"), ("a", 1, ""), (None, 1, "r")], key=repr)
