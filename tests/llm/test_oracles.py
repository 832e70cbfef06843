"""Queries of the subpackage that SQL can express give its rows."""

import os

import duckdb
import pytest

from leafmill.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in ("conversations", "pages", "embeddings", "documents", "benchmark"):
        c.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    got, want = queries.queries()[name](spark, DIR).toPandas(), c.execute(queries.oracle_sql()[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda p: sorted(tuple("~" if x is None or x != x else str(x) for x in r) for r in p[columns].itertuples(index=False))
    assert plain(got) == plain(want)
