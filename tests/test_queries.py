"""Every query against its SQL on the smallest data."""

import pytest
from conftest import SMALL

import __spark_entry__ as repo
import check


@pytest.fixture(scope="module")
def con():
    return check.duck(SMALL)


def test_entry(spark):
    rows = repo.entry(spark).collect()
    assert {r["split"] for r in rows} == {"train", "test"}


def test_every_sql_has_a_query():
    assert set(repo.oracle_sql()) <= set(repo.queries())


@pytest.mark.parametrize("name", sorted(repo.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    verdict, _ = check.compare(spark, con, name, SMALL)
    assert verdict == "ok"
