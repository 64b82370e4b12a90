import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lingora.llm import hard_negatives

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, label int, embedding array<double>"
COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute(rows, every):
    """rows: (vec_id, label, entries) that take part; plain integers."""
    xs = {i: (label, [int(np.floor(256 * c)) for c in v]) for i, label, v in rows}
    out = []
    for a, (label, x) in xs.items():
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, other) for i, (other, y) in xs.items() if i != a)
        for minus, positive, _ in [s for s in scored if s[2] == label][:5]:
            fits = [(-s, i) for s, i, other in scored if other != label and 30 * -minus <= 100 * -s <= 90 * -minus]
            out += [(a, positive, rank, i, -minus, s) for rank, (s, i) in enumerate(fits[:10], 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_query_equals_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = sorted(duck.execute(f"SELECT {', '.join(COLUMNS)} FROM ({hard_negatives.ORACLE_SQL})").fetchall())
    assert len(want) > 100 and got(hard_negatives.op12_hard_negatives(spark, SF)) == want


@pytest.mark.parametrize("sizes", [(256, 2048, 32), (3, 16, 2)])
def test_random_vectors_with_ties_and_a_common_label(spark, monkeypatch, sizes):
    for name, size in zip(("ANCHORS", "ROWS", "WIDTH"), sizes):
        monkeypatch.setattr(hard_negatives, name, size)
    rng = random.Random(sizes[0])
    rows = [(i, rng.choice([1, 1, 1, 2, 3, i % 40]), [rng.choice([-0.2, 0.1, 0.3, 0.5]) for _ in range(9)]) for i in range(160)]
    rows += [(200 + i, 1, [0.3] * 9) for i in range(50)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7).selectExpr("*", "1 as score", "2 as x", "3 as anchor_id")
    assert got(hard_negatives.mine(df, F.col("vec_id") % 4 == 0)) == brute(rows, 4)


def test_odd_rows(spark):
    good = [(i, i % 3, [float(i % 5) / 4, 1.0, 0.5 + i % 2]) for i in range(30)] + [(33, 1, [1.0]), (36, 7, [0.5, 0.5, 0.5]), (39, 2, []), (42, 1, [-1.0, -1.0, -1.0])]
    odd = [(None, 1, [1.0, 1.0, 1.0]), (45, None, [1.0, 1.0, 1.0]), (48, 1, None), (51, 1, [1.0, None, 1.0]), (54, 1, [float("nan"), 1.0, 1.0]), (57, 1, [1.0, float("-inf"), 1.0])]
    df = spark.createDataFrame(good + odd + good[:5], SCHEMA)
    assert got(hard_negatives.mine(df, F.col("vec_id") % 3 == 0)) == brute(good, 3)
    assert got(hard_negatives.mine(df.where("false"), F.col("vec_id") % 3 == 0)) == []
    assert got(hard_negatives.mine(df, F.col("vec_id") % 3 == 5)) == []


def test_large_entries_stay_exact(spark):
    rng = random.Random(1)
    rows = [(i, i % 2, [rng.uniform(-2e5, 2e5) for _ in range(4)]) for i in range(40)]
    assert got(hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 2 == 0)) == brute(rows, 2)
