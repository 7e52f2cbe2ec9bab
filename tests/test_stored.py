"""Stored tables: one name in two modules is two tables."""

from __future__ import annotations

from rankpanel.catalog import fitted as fitted_queries
from rankpanel.catalog import trials as trial_queries
from rankpanel.plans import search
from rankpanel.sources.tables import stored
from tests.conftest import SF


def test_builders_of_one_name_keep_their_tables(spark):
    def first():
        return spark.range(1).select("id")

    def second():
        return spark.range(2).selectExpr("id AS other")

    assert stored(spark, SF, "same-name", first).columns == ["id"]
    assert stored(spark, SF, "same-name", second).columns == ["other"]
    assert stored(spark, SF, "same-name", first).columns == ["id"]


def test_searched_settings_are_not_finish_ranks(spark, monkeypatch):
    """F5 to F7 after D12 in one session."""
    monkeypatch.setattr(search, "search", lambda *args, **kwargs: [search.Trial(0, {"maxDepth": 2.0}, [0.5] * 5, True)])
    monkeypatch.setattr("rankpanel.sources.tables._stored", {})
    assert "params" in fitted_queries.found_trials(spark, SF).columns
    assert {"trial_id", "Driver", "pos"} <= set(trial_queries.ranked(spark, SF).columns)
