"""Every registered query against its DuckDB oracle (sf0.001), and the entry smoke check."""
import pytest

import __spark_entry__ as E
from netlens.plans import catalog
from tests.oracle_compare import compare, duck

SF = "/root/testdata/sf0.001"
SQL = catalog.ORACLE


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    assert compare(spark, con, name, E.queries()[name], SQL[name], SF, verbose=True)


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "log_rate" in df.columns and len(df.columns) == 3 + 73


def test_every_query_has_entry():
    qs = E.queries()
    assert set(SQL) <= set(qs)
