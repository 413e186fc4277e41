"""Every registered query against its SQL form on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check_queries import compare, connect
from emberlog.plans.base import CATALOGUE

FOLDER = "/root/testdata/sf0.001"

# results whose SQL form does not exist
NO_SQL = set()


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(CATALOGUE))
def test_query(spark, db, name):
    problem, _ = compare(name, spark, db, FOLDER)
    assert not problem


def test_every_query_has_sql():
    assert set(CATALOGUE) - set(entry.oracle_sql()) == NO_SQL


def test_entry(spark):
    assert entry.entry(spark).count() > 0
