"""Every query against its SQL on another engine, over the smallest tables."""

import pytest
from parity import SF_DIR, connection, differences

from tidemark.plans import registry


@pytest.fixture(scope="module")
def con():
    return connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    assert differences(registry.QUERIES[name](spark, SF_DIR), con, registry.ORACLES[name]) == ""


def test_contract():
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
