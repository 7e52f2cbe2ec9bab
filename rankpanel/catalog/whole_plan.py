"""C21 with every feature: its oracle joins the oracles of the single steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankpanel.catalog.base import ORACLES, panel, query, rounded
from rankpanel.catalog.features import CATEGORIES, circuits
from rankpanel.catalog.history import NUDGE
from rankpanel.plans.features import FeatureInputs, build_features
from rankpanel.sources.tables import ROW_KEY

#: Steps whose oracles give the features by row.
STEPS = (
    "c1_driver_rolling_means", "c2_team_rolling_means", "c3_driver_ewm", "c4_team_ewm", "c5_category_flags", "c6_circuit_attributes",
    "c8_cluster_aggregates", "c9_driver_minus_team_form", "c10_driver_sprint_count", "c10_team_sprint_count", "c11_weather_flags",
    "c12_season_progress", "c13_driver_cluster_form", "c13_team_cluster_form", "c14_gap_to_team_best", "c15_gap_to_pole", "c16_grid_delta",
    "c17_driver_cluster_uplift", "c17_team_cluster_uplift", "c18_percent_rank_adjustment", "c19_interactions", "c20_driver_season_points",
    "c20_team_season_points",
)


def _joined() -> str:
    team = {s for s in STEPS if "_team_" in s} - {"c9_driver_minus_team_form", "c14_gap_to_team_best"}
    parts = [f"(SELECT * EXCLUDE Team FROM ({ORACLES[s]}))" if s in team else f"({ORACLES[s]})" for s in STEPS]
    return "SELECT * FROM " + " JOIN ".join(p if not i else f"{p} USING (Year, Race_Num, Driver)" for i, p in enumerate(parts))


@query("c21_whole_plan", _joined())
def c21_whole(spark, sf):
    """All 97 columns the steps make, from one plan."""
    out = build_features(panel(spark, sf), inputs=FeatureInputs(circuits=circuits(spark, sf), categories=CATEGORIES))
    made = [c for c in out.columns if c in COLUMNS]
    return rounded(out.select(*ROW_KEY, *[(F.col(c) + NUDGE).alias(c) if "_EWM_" in c else F.col(c) for c in made]))


def _columns() -> tuple[str, ...]:
    entities = [f"{who}_{kind}_{m}_{w}" for who in ("Driver", "Team") for kind in ("Avg", "EWM") for m in ("Position", "Quali_Pos", "DNF") for w in ("short", "medium", "long", "season")]
    both = [f"{who}_{c}" for who in ("Driver", "Team") for c in ("Sprint_Count_Prev", "Cluster_Avg_Quali", "Cluster_Avg_Race", "Cluster_Uplift", "Season_Points", "FormShort_x_Overtake")]
    single = """CircuitType_street CircuitType_high_speed CircuitType_technical Pit_Loss_Time Overtake_Difficulty Expected_Pit_Stops SC_Probability
        Track_Pos_Importance Tyre_Degradation Cluster_Avg_SC_Prob Cluster_Avg_Overtake Cluster_Avg_PitLoss Teammate_Gap_Quali_short Teammate_Gap_Race_short
        is_wet_race temp_deviation is_windy Season_Progress Quali_Delta_Teammate Quali_Time_s Quali_Gap_To_Pole Quali_Gap_Pct Grid_Delta Adj_Grid_Delta
        Grid_x_TrackImportance""".split()
    return (*entities, *both, *single)


COLUMNS = frozenset(_columns())
