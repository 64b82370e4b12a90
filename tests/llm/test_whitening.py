import random
from fractions import Fraction

import numpy as np
import pytest

from lingora.llm import whitening

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(vectors, k=16):
    """Plain exact arithmetic: n, deviations by vector, eigenvalues, components, trace."""
    xs = sorted({tuple(int(np.floor(64 * float(c))) + 1_000_000 for c in v) for v in vectors})
    n, d = len(xs), len(xs[0])
    sums = [sum(x[i] for x in xs) for i in range(d)]
    centred = [[n * a - s for a, s in zip(x, sums)] for x in xs]
    cov = np.array([[float(Fraction(sum(y[i] * y[j] for y in centred), n**3)) for j in range(d)] for i in range(d)])
    values, parts = np.linalg.eigh(cov)
    deviation = {x: sum(c * c for c in y) for x, y in zip(xs, centred)}
    return n, sums, deviation, values[::-1][:k], parts[:, ::-1][:, :k], float(np.trace(cov))


def compare(rows, vectors, k=16):
    """rows: of the operator; vectors: (vec_id, entries) that take part."""
    n, sums, deviation, values, parts, trace = brute([v for _, v in vectors], k)
    assert len(rows) == len(vectors) * len(values)
    got = {}
    for r in rows:
        got.setdefault((r.vec_id, r.deviation), {})[r.component] = r
    signs = None
    for vec_id, v in vectors:
        x = tuple(int(np.floor(64 * float(c))) + 1_000_000 for c in v)
        own = got[vec_id, deviation[x]]
        assert sorted(own) == list(range(1, len(values) + 1))
        want = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)]) @ parts / np.sqrt(values)
        have = np.array([own[c].whitened for c in sorted(own)])
        if signs is None:
            signs = np.sign(want * have)
        assert np.allclose(have, want * signs, rtol=1e-7, atol=1e-8)
        for c, e in enumerate(values, 1):
            assert own[c].n == n and own[c].explained == pytest.approx(e / trace, rel=1e-9) and own[c].identity_error < 1e-9


def test_query_equals_exact_arithmetic(spark):
    found = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    compare(whitening.op13_whitening(spark, SF).collect(), [(r.vec_id, r.embedding) for r in found])


def test_odd_vectors_and_repeated_rows(spark):
    rng = random.Random(2)
    good = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(5)]) for i in range(40)] + [(None, [0.5, 1.0, -1.0, 0.25, 2.0])]
    good += [(1000 + i, good[0][1]) for i in range(60)]
    odd = [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0]), (502, [float("nan")] * 5), (503, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (504, []), (505, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in good + odd], SCHEMA).selectExpr("*", "1 as n", "'x' as x", "2 as component").repartition(5)
    compare(whitening.whiten(df).collect(), good)
    assert whitening.whiten(df.where("vec_id >= 500 and vec_id < 505")).collect() == []
    assert whitening.whiten(df.where("false")).collect() == []


def test_one_vector_and_a_dimension_without_variance(spark):
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], SCHEMA)).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one) == [(i, c, 1, 0, None, 0.0, None) for i in (1, 2) for c in (1, 2)]
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 7.0], 0) for i in range(9)], SCHEMA)).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in flat) and {round(r.identity_error, 12) for r in flat} == {0}


def test_digit_slices_recombine_to_exact_products():
    rng = np.random.default_rng(4)
    z = rng.integers(-(2**62), 2**62, (300, 4))
    total = {w: np.zeros((4, 4), np.int64) for w in range(20)}
    whitening.add_products(total, z)
    want = [[sum(a * b for a, b in zip(z[:, i].tolist(), z[:, j].tolist())) for j in range(4)] for i in range(4)]
    assert [[sum(int(total[w][i, j]) << whitening.LIMB * w for w in total) for j in range(4)] for i in range(4)] == want
    assert all(np.abs(part).max() <= 2 ** (whitening.LIMB - 1) for part in whitening.limbs(z))


def test_far_values_stay_exact(spark):
    rows = [(i, [1e9 * i + 0.5, -3e7 * i * i, 1e30 if i == 3 else 0.0], 0) for i in range(12)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    xs = [[int(np.clip(np.floor(64 * c), -(2.0**61), 2.0**61)) + 1_000_000 for c in v] for _, v, _ in rows]
    sums = [sum(x[i] for x in xs) for i in range(3)]
    for r in got.collect():
        exact = sum((12 * a - s) ** 2 for a, s in zip(xs[r.vec_id], sums))
        assert r.deviation == (exact if exact < 2**63 else None)
