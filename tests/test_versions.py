import random

from pyspark.sql import functions as F

from lingora.operators import versions as V


def test_restore_by_batch_and_target(spark):
    rng = random.Random(3)
    state, history, contents = {}, [], None
    versions = None
    for batch in range(1, 5):
        files = [(p, rng.choice(["a", "b", None, "c" * 9])) for p in ("src/a", "src/a/b.ts", "src/ab.ts", "lib/x") if rng.random() < 0.7 or batch == 1]
        frame = spark.createDataFrame(files, "path string, content string")
        new = V.taken(frame, F.lit(batch), F.lit(f"2024-01-0{batch}"))
        versions = new if versions is None else versions.unionByName(new)
        empty = spark.createDataFrame([], "hash string, content string")
        contents = V.new_contents(frame, empty) if contents is None else contents.unionByName(V.new_contents(frame, contents))
        state = {**state, **dict(files)}
        history.append(dict(state))
    assert contents.count() == len({c for s in history for c in s.values()})
    for batch, want in enumerate(history, 1):
        assert {r.path: r.content for r in V.restored(versions, contents, batch=batch).collect()} == want
    assert {r.path for r in V.listed(versions, "src/a/").collect()} == {"src/a", "src/a/b.ts"}
    assert {r.path: r.content for r in V.restored(versions, contents, "lib/x").collect()} == {"lib/x": history[-1]["lib/x"]}
    there = spark.createDataFrame([(p, c) for p, c in history[-1].items()], "path string, content string")
    differ = {p: c for p, c in history[0].items() if c != history[-1][p]}
    assert {r.path: r.content for r in V.changed_since(versions, contents, there, batch=1).collect()} == differ
    assert V.changed_since(versions, contents, there).count() == 0 and V.restored(versions, contents, batch=0).count() == 0


def test_several_versions_in_a_batch(spark):
    rows = spark.createDataFrame([("p", "h1", 1, "a"), ("p", "h2", 1, "b"), ("p", "h0", None, "z")], "path string, hash string, batch long, at string")
    assert [(r.hash, r.batch) for r in V.listed(rows).collect()] == [("h2", 1)]
    assert [(r.hash, r.batch) for r in V.listed(rows, batch=0).collect()] == [("h0", None)]
