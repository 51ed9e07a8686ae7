"""Every registered query against its DuckDB oracle on the smallest tables
(rows-only for the queries without SQL)."""
import pytest

from freightline.catalog import load_all
from oracle_check import compare, duck

REG = load_all()


@pytest.fixture(scope="module")
def con(sf_small):
    return duck(sf_small)


@pytest.mark.parametrize("name", sorted(REG))
def test_query_matches_oracle(spark, sf_small, con, name):
    fn, sql = REG[name]
    got = fn(spark, sf_small).toPandas()
    assert got is not None
    if sql:
        ok, msg = compare(got, con.sql(sql).df())
        assert ok, msg
