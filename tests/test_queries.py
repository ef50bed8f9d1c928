"""Every registered query against its SQL, at the smallest scale."""

from __future__ import annotations

import pytest

import __spark_entry__ as driver
from refload.plans import catalogue
from tests.conftest import SF
from tests.oracle import connect, difference

QUERIES, SQL = dict(catalogue.QUERIES), dict(catalogue.ORACLE_SQL)


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert difference(got, duck.sql(SQL[name]).df()) is None


def test_entry(spark):
    rows = driver.entry(spark).collect()
    assert [r.version for r in sorted(rows, key=lambda r: r.version)] == [1, 2]
