"""Every query of the library against its SQL on the smallest tables."""

import pytest

from spanloom.jobs import registry
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    same(spark, registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
