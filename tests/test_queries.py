"""Every query that SQL can express gives SQL's rows; the others give rows."""

from __future__ import annotations

import compare
import pytest

from siltstone.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return compare.connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sf, con, name):
    assert compare.differences(QUERIES[name](spark, sf), con, ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_without_sql(spark, sf, name):
    found = QUERIES[name](spark, sf)
    assert found.columns
    if name != "auto_supersession":  # no two documents are so alike here; test_rules holds it to a brute-force version
        assert found.count() > 0


def test_entry(spark, con):
    import __spark_entry__

    assert compare.differences(__spark_entry__.entry(spark), con, ORACLES["context_pack_ranked"]) == []
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
