"""Every registered query equals its SQL oracle, value by value."""

import pytest

import __spark_entry__ as entry_module
from tests.oracle_check import connect, differences, duck_rows, spark_rows
from tillweave.queries import QUERIES

DIRECTORY = "/root/testdata/sf0.001"
ORACLE = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(DIRECTORY)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(ORACLE) <= set(entry_module.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_oracle(spark, duck, name):
    names, rows = spark_rows(QUERIES[name](spark, DIRECTORY))
    duck_names, expected = duck_rows(duck, ORACLE[name])
    assert names == duck_names
    assert len(rows) == len(expected)
    assert not differences(rows, expected)


def test_entry_runs(spark):
    assert entry_module.entry(spark).limit(1).count() == 1
