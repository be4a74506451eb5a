"""Every registered query against its SQL twin on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from shelfline.plans import catalog
from tests.oracle_check import compare, connect

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_all_queries_have_a_twin():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
@pytest.mark.filterwarnings("ignore::UserWarning")
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    assert compare(df, duck, ORACLES[name]) in (None, "no rows")
