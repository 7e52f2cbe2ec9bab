"""Preparation and the configured feature plan.

Steps are named; each contributes lags and column functions to fixed phases, so
any subset costs at most one shuffle for all driver history, one aggregate and
join for all team history, and one for the event gaps.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankpanel.functions.columns import FINISHED_STATUSES, dnf_flag
from rankpanel.operators import features as ft
from rankpanel.operators.clean import coerce, ensure_columns, left_join_coalescing
from rankpanel.operators.store import latest_by
from rankpanel.session import join_small

log = logging.getLogger(__name__)

KEY = ["Year", "Race_Num", "Driver"]
NUMBERS = ("Position", "Grid", "Laps", "Points", "AirTemp", "Humidity", "Pressure", "WindSpeed", "Rainfall")


def prepare(
    races: DataFrame,
    qualifying: DataFrame,
    load_order: Sequence[str] = ("Date",),
    finished: Sequence[str] = FINISHED_STATUSES,
) -> DataFrame:
    """Types, DNF flag, last loaded row per key, qualifying joined in, grid filled from qualifying.

    ``load_order`` names the columns that say which row was loaded later; rows
    equal in them are ordered by all their values, so the result never depends
    on the order of files.
    """

    def last(df: DataFrame) -> DataFrame:
        return latest_by(df, KEY, [*load_order, *sorted(c for c in df.columns if c not in {*KEY, *load_order})])

    races = coerce(races, numbers=NUMBERS, dates=("Date",))
    status = F.col("Status") if "Status" in races.columns else F.lit(None).cast("string")
    races = last(races.withColumn("DNF", dnf_flag(status, finished)))
    q = coerce(qualifying, numbers=("Position", "Quali_Pos"), dates=("Date",))
    rename = {} if "Quali_Pos" in q.columns else {"Position": "Quali_Pos"}
    q = last(ensure_columns(q, {"Quali_Pos": "double"}, rename))
    out = left_join_coalescing(races, q, KEY)
    if "Grid" in out.columns:
        out = out.withColumn("Grid", F.coalesce("Grid", "Quali_Pos"))
    return out


@dataclass
class FeatureInputs:
    """Side tables and settings of the steps."""

    circuits: DataFrame | None = None
    clusters: DataFrame | None = None
    rounds: DataFrame | None = None
    categories: dict[str, Sequence[str]] = field(default_factory=lambda: dict(ft.CATEGORIES))
    metrics: Sequence[str] = ft.METRICS
    windows: dict[str, int] = field(default_factory=lambda: dict(ft.WINDOWS))
    num_clusters: int = 4


@dataclass(frozen=True)
class Step:
    """``before`` adds columns the lags need, ``lags`` names history, ``after`` combines them."""

    needs: tuple[str, ...] = ()
    before: Callable[[DataFrame, FeatureInputs], DataFrame] | None = None
    lags: Callable[[str, FeatureInputs, set[str]], list[ft.Lag]] | None = None
    best: dict[str, str] = field(default_factory=dict)
    after: Callable[[DataFrame], DataFrame] | None = None


def _circuit(df: DataFrame, inputs: FeatureInputs) -> DataFrame:
    df = ft.category_flags(df, inputs.categories)
    if inputs.circuits is None:
        df = df.withColumns({a: F.lit(0.0) for a in ft.ATTRIBUTES})
    else:
        df = ft.circuit_attributes(df, inputs.circuits)
    if "Circuit_Cluster" in df.columns:
        return df
    clusters = inputs.clusters if inputs.clusters is not None else ft.circuit_clusters(df, inputs.num_clusters)
    return join_small(df, clusters, ["Circuit"], "clusters").select(*df.columns, "Circuit_Cluster")


def _present(metrics: Sequence[str], have: set[str]) -> list[str]:
    return [m for m in metrics if m in have]


def _team_quali_delta(df: DataFrame) -> DataFrame:
    return df.withColumn("Quali_Delta_Teammate", F.col("Quali_Pos") - F.col("_team_best")).drop("_team_best")


STEPS: dict[str, Step] = {
    "rolling": Step(lags=lambda e, i, have: ft.rolling_lags(e, _present(i.metrics, have), i.windows)),
    "time_decay": Step(lags=lambda e, i, have: ft.ewm_lags(e, _present(i.metrics, have), i.windows)),
    "circuit": Step(needs=("Circuit",), before=_circuit),
    "circuit_aggregates": Step(after=ft.cluster_aggregates),
    "season_progress": Step(needs=("Year", "Race_Num"), before=lambda df, i: ft.season_progress(df, i.rounds)),
    "cluster_form": Step(needs=("Circuit_Cluster",), lags=lambda e, i, have: [x for x in ft.cluster_lags(e) if x.source in have]),
    "team_gap": Step(after=ft.team_form_gap),
    "sprint": Step(before=lambda df, i: ft.sprint_flag(df), lags=lambda e, i, have: ft.sprint_lags(e)),
    "quali_delta": Step(needs=("Team", "Quali_Pos"), best={"_team_best": "Quali_Pos"}, after=_team_quali_delta),
    "quali_time": Step(before=lambda df, i: ft.quali_seconds(df), after=ft.quali_gap_to_pole),
    "grid_uplift": Step(
        needs=("Grid", "Position"),
        before=lambda df, i: ft.adjusted_grid_delta(ft.grid_delta(df)),
        lags=lambda e, i, have: ft.uplift_lags(e) if "Circuit_Cluster" in have else [],
    ),
    "championship": Step(needs=("Points",), lags=lambda e, i, have: ft.championship_lags(e)),
    "interactions": Step(after=ft.interactions),
    "weather": Step(after=ft.weather_flags),
}
DEFAULT_STEPS = tuple(STEPS)


def build_features(panel: DataFrame, steps: Sequence[str] = DEFAULT_STEPS, inputs: FeatureInputs | None = None) -> DataFrame:
    """Run the named steps as one lazy plan; unknown names are skipped with a warning."""
    inputs = inputs or FeatureInputs()
    chosen: list[Step] = []
    for name in steps:
        if name not in STEPS:
            log.warning("unknown feature step %r skipped", name)
            continue
        chosen.append(STEPS[name])
    events = panel.select("Year", "Race_Num").distinct().count()
    df, active = panel, []
    for step in chosen:
        if not set(step.needs) <= set(df.columns):
            continue
        active.append(step)
        if step.before:
            df = step.before(df, inputs)
    have = set(df.columns)
    lagging = [s for s in active if s.lags]
    if "Driver" in have and lagging:
        df = ft.driver_history(df, [x for s in lagging for x in s.lags("Driver", inputs, have)], events)
    best = {k: v for s in active for k, v in s.best.items()}
    if "Team" in have and (lagging or best):
        df = ft.team_history(df, [x for s in lagging for x in s.lags("Team", inputs, have)], best, events)
    for step in active:
        if step.after:
            df = step.after(df)
    return df
