"""Every query of the subpackage that has SQL gives the rows of its SQL, on the smallest tables."""

import duckdb
import pytest

from lingora.llm import queries
from tests.llm.util import SF


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "conversations", "labels", "benchmark", "embeddings"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert sorted(map(tuple, got[columns].values.tolist()), key=repr) == sorted(map(tuple, want[columns].values.tolist()), key=repr)
