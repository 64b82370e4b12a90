import importlib.util
import os
import shutil

import pytest
from pyspark.sql import functions as F

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline module is not there")

from lingora.llm import decontaminate as D  # noqa: E402
from lingora.llm import line_dedup, quality_rules  # noqa: E402
from tests.llm import test_bpe, test_decontaminate, test_jaccard, test_line_dedup, test_quality_rules  # noqa: E402
from tests.llm.util import ODD, SF, docs_frame  # noqa: E402


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_stages_equal_brute_force_on_small_tables(spark, tmp_path):
    import corpus_pipeline as P

    where = str(tmp_path / "sf")
    shutil.copytree(SF, where)
    os.chmod(where, 0o755)
    shutil.rmtree(f"{where}/documents.parquet", ignore_errors=True)
    if os.path.exists(f"{where}/documents.parquet"):
        os.remove(f"{where}/documents.parquet")
    base = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 1500")
    base = base.withColumn("source", F.concat(F.lit("host"), F.pmod("doc_id", F.lit(2))))  # with pages enough for a ratio
    base.unionByName(docs_frame(spark, [*ODD[:3], *ODD[3:6]])).unionByName(base.limit(3)).coalesce(2).write.parquet(f"{where}/documents.parquet")
    docs = spark.read.parquet(f"{where}/documents.parquet")
    columns = docs.columns
    for (name, stage), check in zip(P.STAGES, (_quality, _lines, _near, _clean, _tokens)):
        before = rows_of(docs)
        out = stage(spark, docs, where)
        if name != "byte_bpe":
            assert out.columns == columns
        out.write.parquet(f"{where}/{name}")
        docs = spark.read.parquet(f"{where}/{name}")
        check(spark, where, before, rows_of(docs))
    assert sorted(rows_of(P.run(spark, where)), key=str) == sorted(rows_of(docs), key=str)


def test_empty_tables_and_extra_columns(spark, tmp_path):
    import corpus_pipeline as P

    base = spark.read.parquet(f"{SF}/documents.parquet").limit(12)
    extra = base.selectExpr("*", "1 AS cid", "'k' AS keys", "2 AS shared", "true AS leaked", "'r' AS raw", "3 AS label", "doc_id AS __doc", "4 AS host", "5 AS n_words")
    odd = extra.unionByName(docs_frame(spark, ODD), allowMissingColumns=True)
    for docs, labels, benchmark in ((odd, True, False), (odd, False, True), (odd.where("false"), True, True)):
        where = str(tmp_path / f"{labels}{benchmark}{docs.count()}")
        docs.write.parquet(f"{where}/documents.parquet")
        for name, full in (("labels", labels), ("benchmark", benchmark)):
            table = spark.read.parquet(f"{SF}/{name}.parquet")
            (table if full else table.where("false")).write.parquet(f"{where}/{name}.parquet")
        docs = spark.read.parquet(f"{where}/documents.parquet")
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, docs, where)
            assert out.columns == docs.columns, name
            assert out.count() <= docs.count()
        assert P.run(spark, where).columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
        if not docs.count():
            assert P.run(spark, where).count() == 0


def _quality(spark, where, before, after):
    docs = spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long")
    forest = quality_rules.train(docs, spark.read.parquet(f"{where}/labels.parquet"))
    verdict = {(r.doc_id, r.n_words): r.kept for r in quality_rules.judge(docs, forest).collect()}
    want = [r for r in before if verdict[r[0], test_quality_rules.counts(r[1])[0]]]
    assert sorted(after, key=str) == sorted(want, key=str)
    assert not any(test_quality_rules.counts(r[1])[5] for r in after)


def _lines(spark, where, before, after):
    want = test_line_dedup.brute([(r[0], r[1], r[3]) for r in before], line_dedup.RATIO, line_dedup.LEAST)
    assert sorted(((r[0], r[1]) for r in after), key=str) == sorted(((d, t) for d, _, _, t in want), key=str)


def _near(spark, where, before, after):
    component = {}
    for (d, n, c) in test_jaccard.brute([(r[0], r[1]) for r in before]):
        component[d] = (n, c)
    want = {d for d, (n, c) in component.items() if n == 0 or c == d}
    assert {r[0] for r in after} == want and len(after) == len({r[:2] for r in after})


def _clean(spark, where, before, after):
    items = [(r.item_id, D.normal(r.text.encode())) for r in spark.read.parquet(f"{where}/benchmark.parquet").collect()]
    short = [r for r in before if len(r[1] or "") < 120]
    kept = {r[0] for r in after}
    for r, (_, n) in zip(short, test_decontaminate.brute(items, [D.normal((r[1] or "").encode()) for r in short])):
        assert (r[0] in kept) == (n == 0)
    assert not any(x in D.normal((r[1] or "").encode()) for r in after for _, x in items)


def _tokens(spark, where, before, after):
    want = test_bpe.want([(r[0], r[1]) for r in before])
    got = [(d, n, test_bpe.sha(",".join(map(str, ids)).encode()), text) for d, n, ids, text in after]
    assert sorted(got, key=str) == want
