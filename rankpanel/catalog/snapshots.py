"""Features of new events from history snapshots, against the oracles over the whole history."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankpanel.catalog.base import ORACLES, panel, query, rounded
from rankpanel.catalog.history import NUDGE
from rankpanel.operators import features as ft
from rankpanel.operators import snapshots
from rankpanel.session import materialize
from rankpanel.sources.tables import ROW_KEY

LAST = 2001
STEPS = ("c1_driver_rolling_means", "c3_driver_ewm", "c10_driver_sprint_count", "c13_driver_cluster_form", "c20_driver_season_points")


def _oracle() -> str:
    parts = [f"({ORACLES[s]})" for s in STEPS]
    joined = " JOIN ".join(p if not i else f"{p} USING (Year, Race_Num, Driver)" for i, p in enumerate(parts))
    return f"SELECT * FROM (SELECT * FROM {joined}) WHERE Year = {LAST}"


def _lags() -> list[ft.Lag]:
    return ft.rolling_lags("Driver") + ft.ewm_lags("Driver") + ft.sprint_lags("Driver") + ft.cluster_lags("Driver") + ft.championship_lags("Driver")


def _features(df):
    outs = [lag.out for lag in _lags()]
    return rounded(df.select(*ROW_KEY, *[(F.col(c) + NUDGE).alias(c) if "_EWM_" in c else F.col(c) for c in outs]))


@query("b24_snapshot_features", _oracle())
def b24_snapshot(spark, sf):
    """The last season's driver features from a snapshot of all seasons before it."""
    rows = panel(spark, sf)
    taken = snapshots.take(rows.where(F.col("Year") < LAST), "Driver", _lags())
    return _features(snapshots.resume(rows.where(F.col("Year") == LAST), taken))


@query("b24_advanced_features", _oracle())
def b24_advanced(spark, sf):
    """The same from a snapshot taken one season earlier and advanced by that season."""
    rows = panel(spark, sf)
    taken = snapshots.take(rows.where(F.col("Year") < LAST - 1), "Driver", _lags())
    later = snapshots.advance(taken, materialize(rows.where(F.col("Year") == LAST - 1), "season"))
    return _features(snapshots.resume(rows.where(F.col("Year") == LAST), later))
