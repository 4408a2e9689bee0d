"""Every query of the core beside its SQL on the smallest tables."""

import os

import pytest

import verify
from lakeloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return verify.connect(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, con, name):
    mine = verify.spark_rows(registry.queries()[name](spark, SF))
    sql = registry.oracle_sql().get(name)
    if sql is not None:
        assert mine == verify.sql_rows(con, sql)


def test_registry():
    assert set(registry.oracle_sql()) <= set(registry.queries())
