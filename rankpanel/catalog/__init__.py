"""Registered queries with their oracle SQL, one module per operator family."""

from rankpanel.catalog import (  # noqa: F401
    evaluation,
    features,
    fitted,
    history,
    laps,
    learning,
    scoring,
    snapshots,
    sources,
    splits,
    streams,
    tables,
    trials,
    whole_plan,
)
from rankpanel.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
