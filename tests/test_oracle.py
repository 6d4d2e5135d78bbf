"""Every registered query of the library against its SQL, on whole tables."""

import os

import pytest

import oracle
from convomill.plans import catalog

EMPTY: set[str] = set()  # queries whose result is empty on these tables
SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.database(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    """Also that there is something to compare, but for the names in EMPTY."""
    difference = oracle.differences(catalog.QUERIES[name](spark, SF), con, catalog.ORACLES[name])
    assert difference == ("no rows" if name in EMPTY else "")
