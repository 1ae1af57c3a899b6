"""Every registered query with SQL, against DuckDB on the smallest tables."""

import os

import pytest
from compare import assert_same, duck

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_matches_sql(spark, con, name):
    rows = assert_same(contract.queries()[name](spark, SF), con, contract.oracle_sql()[name])
    assert rows > 0


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    out = contract.entry(spark)
    assert out.columns == ["accession", "predict", "predict_proba"]
    assert out.count() == 200
