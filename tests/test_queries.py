"""Every registered query of the engine against its SQL."""

import oracle
import pytest

import __spark_entry__
from suffixloom.plans.oracles import ORACLE_SQL
from suffixloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, con, name):
    assert oracle.same(spark, con, QUERIES[name], ORACLE_SQL[name], SF) > 0 or name == "context_orphans"


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
