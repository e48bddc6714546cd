"""Every registered query against its SQL on the smallest sample."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"
QUERIES = {name: query for name, query in entry.queries().items() if name in entry.MOBILITY_QUERIES}
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    assert difference(got, duck.execute(ORACLES[name]).fetchdf()) is None


def test_entry_gives_labelled_pieces(spark):
    assert entry.entry(spark).count() > 0
