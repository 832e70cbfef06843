"""Every query runs at the smallest scale, and its SQL gives the same rows."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(n for n in entry.queries() if not n.startswith("op") and n != "pipeline")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return c


def rows(pdf, columns):
    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "~"
        return repr(float(x)) if isinstance(x, float) or "Decimal" in type(x).__name__ else str(x)

    return sorted(tuple(map(plain, r)) for r in pdf[columns].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sql, name):
    got = entry.queries()[name](spark, DIR).toPandas()
    oracle = entry.oracle_sql().get(name)
    if oracle:
        want = sql.execute(oracle).fetchdf()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        assert rows(got, columns) == rows(want, columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_filters_and_columns_reach_the_scan(spark):
    plan = entry.queries()["J12_unlabelled"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[1].split("\n")[0]


@pytest.mark.parametrize("name", ["T01_text_quality", "T04_keyword_tags", "A11_rule_scores", "X03_field_search"])
def test_hot_paths_stay_in_the_jvm(spark, name):
    plan = entry.queries()[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
