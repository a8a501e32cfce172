"""Every query against its SQL on the smallest tables."""

import pytest
from oracle import TABLES, both

from marlstone.plans import registry


@pytest.mark.skipif(not TABLES.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.queries))
def test_query(spark, name):
    ours, theirs = both(spark, registry.queries[name], registry.oracle_sql[name])
    assert ours == theirs
