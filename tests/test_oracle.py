"""Every query of the library against its SQL, on the smallest tables."""

import pytest
from oracle import connect, same

from tidemark.plans import catalogue


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, con, name):
    same(con, catalogue.ORACLE_SQL[name], catalogue.QUERIES[name](spark, sf))
