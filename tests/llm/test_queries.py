"""Registered queries run over the smallest tables, next to their SQL where they have one."""

import os

import pytest

import __spark_entry__ as entry
from tabsight.llm.queries import ORACLES, QUERIES
from tests.compare import ROOT, compare, duck

DIR = f"{ROOT}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    con = duck(DIR)
    assert compare(spark, con, name, QUERIES[name], ORACLES.get(name), DIR) == []


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())
