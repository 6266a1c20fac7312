"""Every core query against its SQL twin on the smallest tables."""

import pytest

from graphloom import queries
from tests import oracle

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return oracle.views(FOLDER)


def test_names():
    assert set(queries.oracles()) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(queries.oracles()))
def test_same_as_sql(spark, connection, name):
    oracle.assert_same(queries.queries()[name](spark, FOLDER), connection, queries.oracles()[name])
