import json

from lingora.operators import bundle as B

OBJECTS = [
    (1, '{"b": "x", "a": {"c": ["y", {"d": [["z", "x"]]}], "n": 1.5}, "t": true, "e": null, "": "q"}'), (2, '["x", 7, ["y"]]'), (3, '"x"'), (4, "not json"), (5, None), (6, "{}"), (7, '{"k": "x", "x": "k\\"x\\\\ \\u00e9\\n"}'),
    (8, '[ "x" ,\n "y"]'), (9, '{"deep": [[[[[["x"]]]]]]}'),
]


def leaves(v, at=()):
    if isinstance(v, dict | list):
        for k, x in v.items() if isinstance(v, dict) else enumerate(v):
            yield from leaves(x, (*at, str(k)))
    elif at:
        yield ".".join(at), v if isinstance(v, str) else json.dumps(v)


def swapped(v, words):
    if isinstance(v, dict):
        return {k: swapped(x, words) for k, x in v.items()}
    if isinstance(v, list):
        return [swapped(x, words) for x in v]
    return words.get(v, v) if isinstance(v, str) else v


def test_strings_of_objects_at_any_depth(spark):
    got = sorted((r.id, r.path, r.text) for r in B.object_strings(spark.createDataFrame(OBJECTS, "id int, value string")).collect())
    assert got == sorted((i, p, t) for i, v in OBJECTS if i not in (3, 4, 5) for p, t in leaves(json.loads(v)) if t != "null")
    assert B.object_strings(spark.createDataFrame([], "id int, value string")).collect() == []


def test_objects_written_back(spark):
    words = {"x": 'new "x"', "y": "é\\", 'k"x\\ é\n': "k"}
    known = spark.createDataFrame([*words.items(), ("z", None)], "text string, translation string")
    objects = spark.createDataFrame(OBJECTS, "id int, value string")
    done = B.translated_objects(objects, known)
    got = {r.id: r.value for r in done.collect()}
    for i, v in OBJECTS:
        if i in (3, 4, 5):
            assert got[i] == v
        else:
            assert json.loads(got[i]) == swapped(json.loads(v), words)
            assert not v.startswith("{") or list(json.loads(got[i])) == list(json.loads(v))
    assert got[8] == '[ "new \\"x\\"" ,\n "é\\\\"]'
    assert "Python" not in done._jdf.queryExecution().toString() and "MapIn" not in done._jdf.queryExecution().toString()


def test_tokens_of_one_kind_are_dealt_over_tasks(spark):
    from pyspark.sql import functions as F

    tokens = spark.range(400).select("id", F.lit(0).alias("pos"), F.lit("t").alias("token"), F.when(F.col("id") % 2 == 0, "same").alias("text"))
    known = spark.createDataFrame([("same", "SAME")], "text string, translation string")
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        rows = B.looked_up(tokens, known).select("text", "translation", F.spark_partition_id().alias("task")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(rows) == 400 and {(r.text, r.translation) for r in rows} == {(None, None), ("same", "SAME")}
    assert all(len({r.task for r in rows if r.text == text}) > 1 for text in (None, "same"))
