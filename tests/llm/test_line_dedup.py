from collections import Counter

from pyspark.sql import functions as F

from lingora.llm import line_dedup
from tests.llm.util import ODD, SF, WORD, docs_frame


def brute(rows, ratio, least):
    pages = Counter(s or "" for _, _, s in rows)
    on = Counter((s or "", x) for _, t, s in rows if t is not None for x in set(t.split("\n")) if WORD.search(x))
    out = []
    for d, t, s in rows:
        if t is None:
            out.append((d, 0, 0, None))
            continue
        lines = t.split("\n")
        kept = [x for x in lines if not (on[s or "", x] >= least and on[s or "", x] > ratio * pages[s or ""])]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(line_dedup.op5_line_dedup(spark, SF)) == brute(rows, line_dedup.RATIO, line_dedup.LEAST)


def test_hot_and_small_hosts_nulls_ties_and_repeats(spark):
    head = "menu | home | contact"
    rows = [(i, f"{head}\nown line {i}\n\n{head}\n \t", "hot") for i in range(40)]
    rows += [(100 + i, f"footer\nx{i}", f"small{i % 2}") for i in range(6)] + rows[:2]
    rows += [(200, "a.b\na.b", None), (201, "", None), (202, None, "hot"), (203, "\n", "")] + [(d, t, "odd") for d, t in ODD]
    docs = docs_frame(spark, rows).selectExpr("*", "9 as n_lines", "'h' as host", "'k' as key", "1 as keys", "1 as pages")
    for ratio, least in ((0.5, 4), (0.0, 1), (0.1, 3)):
        out = line_dedup.drop_lines(docs, ratio=ratio, least=least)
        assert got(out) == brute(rows, ratio, least)
        assert all(r.n_chars == len(r.text) for r in out.collect() if r.text is not None)
    assert line_dedup.drop_lines(docs.where("false")).count() == 0


def test_plan_has_no_python(spark):
    plan = line_dedup.op5_line_dedup(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_every_line_exceeds_the_ratio_on_a_host_of_few_pages(spark):
    rows = [(1, "a\nb", "few"), (2, "a\nc", "few"), (3, "d", "one")]
    assert got(line_dedup.drop_lines(docs_frame(spark, rows))) == [(1, 2, 2, ""), (2, 2, 2, ""), (3, 1, 1, "")]
    assert got(line_dedup.drop_lines(docs_frame(spark, rows), least=2)) == [(1, 2, 1, "b"), (2, 2, 1, "c"), (3, 1, 0, "d")]


def test_hosts_of_urls(spark):
    urls = ["https://A.example.org:80/x?y", "no url", None]
    frame = spark.createDataFrame([(u,) for u in urls], "url string").select(line_dedup.host_of(F.col("url")).alias("host"))
    assert [r.host for r in frame.collect()] == ["a.example.org", "", ""]
