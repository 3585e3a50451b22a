"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.oracle import TESTED, compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, note = compare(spark, con, QUERIES[name], ORACLES.get(name), SF, name)
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_tests_of_queries_without_sql_exist():
    root = Path(entry.__file__).resolve().parent
    for name, path in TESTED.items():
        assert name not in ORACLES
        assert (root / path).exists() or name not in QUERIES  # the corpus queries go with their tests


def test_oracles_name_queries():
    assert set(ORACLES) <= set(QUERIES)
