"""Every registered query against its DuckDB oracle on the smallest driver tables
(the driver repeats this at sf0.01). Queries without an oracle must run."""

import pytest

import __spark_entry__ as E
from crawlgrid.plans.compare import compare, duck_connect, spark_rows
from crawlgrid.plans.registry import QUERIES as CRAWL, load_all

load_all()

SF = "/root/testdata/sf0.001"
# the training-data operators have their own tests in tests/llm
QUERIES = {n: q for n, q in E.queries().items() if n in CRAWL}
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        r = compare(df, con, ORACLES[name])
        assert r["match"], r
    else:
        cols, data = spark_rows(df)
        assert cols


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "last_status" in df.columns
