"""Every query with an SQL text runs in both engines on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import ROOT, compare, duck

DIR = f"{ROOT}/sf0.001"
ORACLES = entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, con, name):
    problems = compare(spark, con, name, entry.queries()[name], ORACLES[name], DIR)
    assert [p for p in problems if p != "no rows"] == []


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(entry.queries())
