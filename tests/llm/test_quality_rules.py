import numpy as np

from lingora.llm import quality_rules, stats
from tests.llm.util import ODD, SF, WORD, docs_frame, sf_rows


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    hit = set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            hit |= set(range(i, i + 8))
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed


def check(df, rows):
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in df.collect()), key=str)
    assert got == sorted(((d, *counts(t)) for d, t in rows), key=str)


def test_query_counts_and_held_out_verdicts(spark):
    out = quality_rules.op9_quality_rules(spark, "/root/testdata/sf0.01").cache()
    check(out, sf_rows(spark, "/root/testdata/sf0.01"))
    assert out.where("base_failed AND kept").count() == 0
    judged = out.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where(stats.held_out()).where("NOT base_failed").collect()
    assert sum(r.kept == (r.quality == 1) for r in judged) >= 0.95 * len(judged)


def test_odd_texts_without_labels(spark):
    line = "the same line of nine words stands here twice\n"
    rows = ODD + [(1, line * 2 + "and # twenty * more words | follow " * 2), (1, line * 9), (2, "<&>\n<&>\n \n \n")]
    docs = docs_frame(spark, rows).selectExpr("*", "1 as features", "true as kept", "2 as n_words")
    check(quality_rules.judge(docs, None), rows)
    kept = quality_rules.keep(docs, None)
    assert kept.schema == docs.schema
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(d or -1 for d, t in rows if not counts(t)[5])
    assert quality_rules.judge(docs.where("false"), None).count() == 0 == quality_rules.keep(docs.where("false"), None).count()
    nothing = spark.createDataFrame([(1, None, None), (None, 1, 0), (77, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality_rules.train(docs, nothing) is None


def test_forest_learns_and_keeps_its_constraints():
    rng = np.random.default_rng(0)
    x = rng.random((800, 3))
    y = (x[:, 0] + np.abs(x[:, 1] - 0.5) + 0.05 * rng.standard_normal(800) < 0.7).astype(float)
    forest = quality_rules.grow(x, y, [-1, 0, 0])
    assert ((forest.score(x) > 0.5) == y).mean() > 0.9
    for row in rng.random((40, 3)):
        line = np.repeat(row[None], 50, 0)
        line[:, 0] = np.linspace(0, 1, 50)
        assert (np.diff(forest.raw(line)) <= 1e-12).all()
    slow = [forest.base + sum(_walk(forest, r, row) for r in forest.roots) for row in x[:20]]
    assert np.allclose(slow, forest.raw(x[:20]))


def _walk(forest, node, row):
    while forest.left[node] != node:
        node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
    return forest.value[node]
