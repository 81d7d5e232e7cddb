"""The native operators run no Python, and what is done row by row doesn't shuffle."""

import os

import pytest

pytest.importorskip("public_tokenizers")
queries = pytest.importorskip("quarrygraph.llm.queries")

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plan(spark, name):
    return queries.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op6_url_filters", "op8_quality_rules"])
def test_native(spark, name):
    assert not any(k in plan(spark, name) for k in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("name", ["op7_token_counts", "op8_quality_rules"])
def test_no_shuffle(spark, name):
    assert "Exchange" not in plan(spark, name)


def test_queries_match_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        r = c.sql(sql)
        names = [d[0] for d in r.description]
        got = queries.queries()[name](spark, DATA).select(*names).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(r.fetchall(), key=repr)
