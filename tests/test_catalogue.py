"""Every query with SQL against DuckDB on the smallest tables; the others run."""

import pytest
from helpers import rows

from wordwave.plans import catalogue

from conftest import DATA

SLOW = {"gbt_classify"}  # has a test of its own


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, str(DATA)).toPandas()
    want = duck.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) - SLOW))
def test_runs(spark, duck, name):
    assert catalogue.QUERIES[name](spark, str(DATA)).toPandas().shape[1] > 0
