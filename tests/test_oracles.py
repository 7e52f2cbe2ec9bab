"""Every registered query with an oracle, at the smallest scale."""

from __future__ import annotations

import pytest

from rankpanel.catalog import ORACLES, QUERIES
from tests.conftest import SF
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_registry_is_consistent():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 140


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(name, spark, duck):
    assert compare(QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()) is None
