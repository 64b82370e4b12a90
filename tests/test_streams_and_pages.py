"""Streams against their tables, and pages against small documents."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lingora.operators import pages as P
from lingora.operators import runs
from lingora.streaming import observer as O

T0 = datetime(2024, 1, 1)


def test_pages(spark):
    html = "<title>T</title><p>one <b>two</b> three<br>four</p><script>no()</script><div translate='no'>skip</div><img alt='pic'><meta name='description' content='d'><p> </p>tail"
    found = P.nodes(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")).cache()
    groups = P.text_groups(found).orderBy("group_idx").collect()
    assert [g.text for g in groups] == ["T", "one two three", "four", "tail"]
    assert [(f.text, f.offset) for f in groups[1].fragments] == [("one ", 0), ("two", 4), (" three", 7)]
    assert {(r.kind, r.text) for r in found.where("kind <> 'text'").collect()} == {("attribute", "pic"), ("meta", "d")}


def test_split_back(spark):
    f = "array(named_struct('text', 'ab'), named_struct('text', 'cdef'))"
    frame = spark.range(1).select(P.marked(F.expr(f)).alias("m"), P.split_back(F.lit("X\0TM0\0YZ\0TM1\0!"), F.expr(f)).alias("a"), P.split_back(F.lit("123456"), F.expr(f)).alias("b"))
    r = frame.first()
    assert r.m == "ab\0TM0\0cdef\0TM1\0" and r.a == ["X", "YZ!"] and r.b == ["12", "3456"]


def test_cache_replay(spark):
    ops = [("a", 1, 0, "set", "x", "1"), ("a", 2, 0, "set", "y", "2"), ("a", 3, 0, "get", "x", None), ("a", 4, 0, "set", "z", "3"), ("a", 5, 0, "get", "y", None), ("a", 6, 0, "get", "x", None), ("a", 7, 400, "get", "z", None), ("a", 8, 600, "get", "z", None)]
    out = O.replay_cache(spark.createDataFrame(ops, "g string, seq int, ts_ms long, op string, key string, value string"), "g", 2, 500)
    assert {r.seq: r.found for r in out.collect() if r.op == "get"} == {3: "1", 5: None, 6: "1", 7: "3", 8: None}


def _stream(spark, tmp_path, rows, schema):
    at = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(at)
    return spark.readStream.schema(schema).parquet(at)


def _collected(query_df, name):
    q = query_df.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return query_df.sparkSession.table(name).collect()


def test_cached_stream_equals_the_table(spark, tmp_path):
    rows = [(k, T0 + timedelta(seconds=s)) for k, s in (("a", 0), ("a", 50), ("b", 55), ("a", 99), ("a", 100), ("a", 130))]
    got = _collected(O.cached_stream(_stream(spark, tmp_path, rows, "k string, ts timestamp"), "k", 100), "cached")
    table = O.ttl_hits(spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(rows)], "k string, ts timestamp, seq int"), ["k"], 100)
    assert sorted((r.k, r.ts, r.hit) for r in got) == sorted((r.k, r.ts, r.hit) for r in table.collect())


def test_a_value_of_the_exact_age_still_hits(spark):
    rows = [("a", T0 + timedelta(seconds=s), s) for s in (0, 100, 101, 201)] + [(None, T0, 0), (None, T0 + timedelta(seconds=5), 1), ("b", T0, 0)]
    got = O.ttl_hits(spark.createDataFrame(rows, "k string, ts timestamp, seq int"), ["k"], 100).collect()
    assert {r.seq: r.hit for r in got if r.k == "a"} == {0: False, 100: True, 101: False, 201: True}
    assert [r.hit for r in sorted((r for r in got if r.k is None), key=lambda r: r.seq)] == [False, True]
    assert O.ttl_hits(spark.createDataFrame(rows, "k string, ts timestamp, seq int").where("false"), ["k"], 100).count() == 0


def test_stream_drops_repeats_and_debounces(spark, tmp_path):
    rows = [(i, "u", T0 + timedelta(seconds=s)) for i, s in ((1, 0), (1, 0), (2, 10), (3, 5000), (4, 90000))]
    stream = _stream(spark, tmp_path, rows, "event_id long, user_id string, ts timestamp")
    assert sorted(r.event_id for r in _collected(O.incremental(stream), "once")) == [1, 2, 3, 4]
    bursts = O.debounce(spark.createDataFrame(rows, "event_id long, user_id string, ts timestamp"), ["user_id"], "1 minute")
    assert sorted(r.n for r in bursts.collect()) == [1, 1, 3]
    live = _collected(O.debounce(stream, ["user_id"], "1 minute", "1 minute"), "bursts")
    assert sorted(r.n for r in live) in ([1, 3], [])  # the last burst is open until the watermark passes


def test_requests_and_terms(spark):
    items = spark.createDataFrame([("p", i, "x" * n) for i, n in enumerate((5, 5, 5, 30, 1))], "page string, ord int, text string")
    assert [r.request for r in runs.packed_requests(items, ["page"], ["ord"], 17, 2).orderBy("ord").collect()] == [0, 0, 1, 2, 3]
