"""Every query with SQL gives the rows of its SQL, on the smallest tables."""

import duckdb
import pytest

from lingora.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return tuple(map(cell, x))
    if isinstance(x, float):
        return None if x != x else float(f"{x:.9g}")
    return x


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(cell, r)) for r in frame.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES | catalogue.FIXTURES))
def test_query(spark, duck, name):
    sql = (catalogue.ORACLES | catalogue.FIXTURE_ORACLES).get(name)
    got = (catalogue.QUERIES | catalogue.FIXTURES)[name](spark, SF).toPandas()
    if sql:
        want = duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns)


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_no_query_is_registered_twice():
    assert len(set(catalogue.QUERIES.values())) == len(catalogue.QUERIES)


def test_queries_without_sql_keep_what_they_are_given(spark):
    split = catalogue.QUERIES["fragment_split"](spark, SF).collect()
    assert split and all(r.same and r.whole for r in split)
    texts, groups = (catalogue.QUERIES[n](spark, SF).toPandas() for n in ("page_text_groups", "page_language_groups"))
    by_page = texts.groupby("page_id").text.agg(["size", lambda t: t.str.len().sum()])
    found = groups.groupby("page_id")[["groups", "chars"]].sum()
    assert (found.groups <= by_page["size"].reindex(found.index)).all() and found.groups.sum() > 0 and "zh" not in set(groups.lang)
    runs, spaced = (catalogue.QUERIES[n](spark, SF).toPandas() for n in ("language_runs", "run_spacing"))
    assert len(runs) == len(spaced)
    key = next(c for c in runs.columns if c in ("id", "doc_id"))
    ordered = runs.sort_values([key, "run_idx"])
    whole = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    joined = ordered.groupby(key).text.agg("".join)
    assert all(joined.get(d, "") == (t or "") for d, t in whole.items())
    same = (ordered[key] == ordered[key].shift()) & (ordered.lang == ordered.lang.shift())
    assert not same.any()
