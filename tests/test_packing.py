import json
import random

import pytest
from pyspark.sql import functions as F

from lingora.operators import folds, runs


def packed(texts, chars, most):
    """One text after another, by the JSON of the list so far."""
    out, request, now = [], 0, []
    for t in texts:
        if now and (len(json.dumps([*now, t], ensure_ascii=False, separators=(",", ":"))) > chars or len(now) >= most):
            request, now = request + 1, []
        now.append(t)
        out.append(request)
    return out


@pytest.mark.parametrize("fold", [0, 30, runs.FOLD])
def test_packing_equals_one_text_after_another(spark, monkeypatch, fold):
    monkeypatch.setattr(runs, "FOLD", fold)
    rng = random.Random(3)
    texts = {k: ["".join(rng.choices('ab"\\\n é', k=rng.choice([0, 1, 5, 30, 90]))) for _ in range(n)] for k, n in (("a", 120), ("b", 7), ("c", 1))}
    rows = [(k, i, t) for k, ts in texts.items() for i, t in enumerate(ts)]
    frame = spark.createDataFrame(rows, "k string, ord int, text string").repartition(5)
    for chars, most in ((100, 900), (10_000, 4), (60, 3)):
        got = {(r.k, r.ord): r.request for r in runs.packed_requests(frame, ["k"], ["ord"], chars, most).collect()}
        assert got == {(k, i): r for k, ts in texts.items() for i, r in enumerate(packed(ts, chars, most))}


def test_lines_of_documents_by_jumps_equal_the_fold(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text IS NOT NULL")
    lines = docs.select(F.lit("all").alias("k"), "doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    whole = {(r.doc_id, r.ord): r.request for r in runs.packed_requests(lines, ["k"], ["doc_id", "ord"]).collect()}
    monkeypatch.setattr(runs, "FOLD", 10)
    jumped = {(r.doc_id, r.ord): r.request for r in runs.packed_requests(lines, ["k"], ["doc_id", "ord"]).collect()}
    assert max(whole.values()) > 3 and jumped == whole


def test_running_sums(spark):
    rows = [(None if i % 5 == 0 else f"k{i % 3}", i, i % 7) for i in range(200)]
    got = {r.i: r.s for r in folds.running_sum(spark.createDataFrame(rows, "k string, i int, v int"), ["k"], ["i"], F.col("v"), "s").collect()}
    want, total = {}, {}
    for k, i, v in rows:
        want[i] = total[k] = total.get(k, 0) + v
    assert got == want
