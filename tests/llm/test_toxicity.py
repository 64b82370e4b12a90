import ast
import inspect
import zlib

import numpy as np
import pytest

from lingora.llm import toxicity as T
from tests.llm.util import ODD, docs_frame

SF = "/root/testdata/sf0.01"


def test_backpropagation_equals_differences():
    net = T.Network({b"a": 0}, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(2)
    x = rng.standard_normal((6, 5, T.SIZE))
    mask = (np.arange(6)[:, None] < np.array([6, 3, 1, 0, 4])).astype(float)
    y = np.array([1, 0, 1, 0, 1.0])

    def loss():
        out = net.run(net.project(x), mask)
        return np.mean(np.logaddexp(0, out) - y * out)

    grads, d_x, _ = net.gradients(x, mask, y, np.ones(5))
    for name, g in [*grads.items(), ("x", d_x)]:
        target = x if name == "x" else net.p[name]
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in target.shape)
            old = target[at]
            target[at] = old + 1e-5
            up = loss()
            target[at] = old - 1e-5
            down = loss()
            target[at] = old
            assert abs((up - down) / 2e-5 - g[at]) < 1e-3, name  # the output's steps are in single precision


def slow(net, raw):
    words = T.words_of(raw)
    vectors = net.word_vectors(words) if words else np.zeros((0, T.SIZE), np.float32)
    best = -np.inf
    for a, b in T.windows_of(len(words)):
        x = np.zeros((T.WINDOW, 1, T.SIZE), np.float32)
        x[: b - a, 0] = vectors[a:b]
        mask = (np.arange(T.WINDOW)[:, None] < b - a).astype(np.float32)
        best = max(best, net.run(net.project(x), mask)[0])
    return 1 / (1 + np.exp(-best))


def test_scorer_equals_window_by_window():
    net = T.Network({b"moron": 0, b"the": 1}, seed=4)
    net.p["words"][:2] = 1
    raws = [(t or "").encode() for _, t in ODD] + [b"the moron " * 40 + b"end", b"the MORON, the!"]
    scorer = T.Scorer(net)
    assert np.allclose(scorer.score(raws), [slow(net, r) for r in raws], atol=1e-5)
    assert np.allclose(scorer.score(raws[::-1]), [slow(net, r) for r in raws[::-1]], atol=1e-5)


def test_windows_overlap_and_cover():
    for n in (0, 1, 31, 32, 33, 48, 49, 1000):
        spans = T.windows_of(n)
        assert spans[0][0] == 0 and spans[-1][1] == n and all(b - a <= T.WINDOW for a, b in spans)
        assert all(c < b for (_, b), (c, _) in zip(spans, spans[1:]))


def test_held_out_accuracy_of_the_query(spark):
    out = T.op10_toxicity(spark, SF).cache()
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = out.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in rows)
    bad, good = ([r.score for r in rows if r.held_out and r.toxic == k] for k in (1, 0))
    assert np.mean([b > g for b in bad for g in good]) > 0.7  # some 40 toxic texts to learn from


def test_odd_tables(spark):
    docs = docs_frame(spark, [*ODD, (1, "a moron"), (1, "a moron")]).selectExpr("*", "0.1 as score", "1 as y", "2 as raw")
    assert T.train(docs, spark.createDataFrame([(900, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")) is None
    assert all(r.score == 0 and r.held_out is not None for r in T.score(docs, None).collect())
    net = T.train(docs, spark.createDataFrame([(d, int(d in (1, 904))) for d in [x for x, _ in ODD if x] + [1, 2]], "doc_id long, toxic int"))
    rows = T.score(docs, net).collect()
    assert len(rows) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in rows)
    assert T.score(docs.where("false"), net).count() == 0


def test_text_without_spaces_is_whole():
    rng = np.random.default_rng(6)
    for n in [0, 1, 63, 64, 65, 68, 69, 70, 123, 124, 1000]:
        w = bytes(rng.integers(97, 123, n, np.uint8))
        pieces = T.words_of(w)
        assert all(len(p) <= T.LONG for p in pieces) and (len(pieces) == 1 if 0 < n <= T.LONG else True)
        assert all(any(w[i : i + 6] in p for p in pieces) for i in range(n))
    net = T.Network({}, seed=4)
    clean = "这是一个没有空格的句子" * 20
    ends = T.Scorer(net).score([(clean + x).encode() for x in ("", "坏话坏话坏话", "_moron_moron")])
    assert len(set(ends.round(7))) == 3


def test_words_at_once(monkeypatch):
    raws = [b" ".join(b"w%d" % (i * k) for i in range(200)) for k in range(1, 9)]
    y = np.array([0, 1] * 4)
    a = T.learn(raws, y, epochs=3)
    s = T.Scorer(a).score(raws)
    monkeypatch.setattr(T, "AT_ONCE", 7)
    b = T.learn(raws, y, epochs=3)
    assert all(np.array_equal(a.p[k], b.p[k]) for k in a.p) and np.allclose(T.Scorer(b).score(raws), s, atol=1e-6)


def test_training_neither_collects_nor_exceeds_its_bounds(spark, monkeypatch):
    docs = docs_frame(spark, [(i, f"{'vile moron' if i % 2 else 'kind friend'} number {i} " * 20) for i in range(60)])
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    whole = type(docs)
    learned = []
    with monkeypatch.context() as m:
        m.setattr(T, "learn", lambda texts, y: learned.append((list(texts), list(y))))
        for name in ("collect", "toPandas", "take", "head"):
            m.setattr(whole, name, lambda *a, **k: pytest.fail("the sample is collected"))
        T.train(docs, labels)
        T.train(docs, labels, size=2000)
        m.setattr(T, "LONGEST", 10)
        T.train(docs, labels)
    (texts_, y), (few, _), (none, _) = learned
    assert len(texts_) == len(y) > 40 and all((b"moron" in t) == bool(k) for t, k in zip(texts_, y))
    assert few == texts_[: len(few)] and 0 < sum(map(len, few)) <= 2000 and none == []


def test_each_name_is_defined_once():
    for module in (T,):
        names = [n.name for n in ast.parse(inspect.getsource(module)).body if isinstance(n, (ast.FunctionDef, ast.ClassDef))]
        assert len(names) == len(set(names))
