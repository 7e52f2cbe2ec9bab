"""Attributes, gaps, interactions, the whole plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankpanel.catalog.base import event_count, panel, query, rounded, with_results
from rankpanel.catalog.history import _over, _ratio, team_events_sql
from rankpanel.operators import features as ft
from rankpanel.plans.features import FeatureInputs, build_features, prepare
from rankpanel.sources.tables import ROW_KEY, qualifying, races, schedule

# Categories for the derived circuits: two names carry the suffix in the panel, one only here.
CATEGORIES = {"street": ("C01", "C06", "C09"), "high_speed": ("C02", "C05"), "technical": ("C04 Grand Prix", "C11")}


def circuits(spark, sf):
    """Attributes from the round number; rounds 5 and 8 have none."""
    rn = F.col("RoundNumber")
    known = ~rn.isin(5, 8)
    exprs = {
        "Pit_Loss_Time": 18.0 + rn % 5,
        "Overtake_Difficulty": 0.1 * (rn % 7),
        "Expected_Pit_Stops": 1.0 + rn % 3,
        "SC_Probability": 0.05 * rn,
        "Track_Pos_Importance": 0.3 + 0.02 * rn,
    }
    per = schedule(spark, sf).select("RoundNumber", F.col("EventName").alias("Circuit")).distinct()
    cols = [F.when(known, e.cast("double")).alias(c) for c, e in exprs.items()]
    return per.select("Circuit", *cols, F.lit(None).cast("double").alias("Tyre_Degradation"))


ATTRIBUTE_EXPR = {
    "Pit_Loss_Time": "18.0::DOUBLE + Race_Num % 5",
    "Overtake_Difficulty": "0.1::DOUBLE * (Race_Num % 7)",
    "Expected_Pit_Stops": "1.0::DOUBLE + Race_Num % 3",
    "SC_Probability": "0.05::DOUBLE * Race_Num",
    "Track_Pos_Importance": "0.3::DOUBLE + 0.02::DOUBLE * Race_Num",
}
ATTR_SQL = (
    "attr0 AS (SELECT *, "
    + ", ".join(f"CASE WHEN Race_Num NOT IN (5, 8) THEN {e} END AS x_{c}" for c, e in ATTRIBUTE_EXPR.items())
    + " FROM panel),\nattr AS (SELECT *, "
    + ", ".join(f"coalesce(x_{c}, (SELECT quantile_cont(x_{c}, 0.5) FROM attr0)) AS {c}" for c in ATTRIBUTE_EXPR)
    + ", 0.0::DOUBLE AS Tyre_Degradation FROM attr0)"
)


def attributed(spark, sf):
    return ft.circuit_attributes(panel(spark, sf), circuits(spark, sf))


def _cat_sql():
    full = {c: [m if m.endswith(" Grand Prix") else m + " Grand Prix" for m in ms] for c, ms in CATEGORIES.items()}
    name = "CASE WHEN Circuit LIKE '% Grand Prix' THEN Circuit ELSE Circuit || ' Grand Prix' END"
    cols = [f"CASE WHEN {name} IN ({', '.join(repr(m) for m in ms)}) THEN 1 ELSE 0 END AS CircuitType_{c}" for c, ms in full.items()]
    return ", ".join(cols)


@query("c5_category_flags", with_results(f"SELECT Year, Race_Num, Driver, {_cat_sql()} FROM panel"))
def c5(spark, sf):
    out = ft.category_flags(panel(spark, sf), CATEGORIES)
    return out.select(*ROW_KEY, *[f"CircuitType_{c}" for c in CATEGORIES])


@query("c6_circuit_attributes", with_results("SELECT Year, Race_Num, Driver, " + ", ".join(f"round({c}, 6) AS {c}" for c in ft.ATTRIBUTES) + " FROM attr", ATTR_SQL))
def c6(spark, sf):
    return rounded(attributed(spark, sf).select(*ROW_KEY, *ft.ATTRIBUTES))


@query("c7_circuit_clusters")
def c7(spark, sf):
    rows = ft.category_flags(attributed(spark, sf).drop("Circuit_Cluster"), CATEGORIES)
    return ft.circuit_clusters(rows)


@query("c7_cluster_properties", with_results("SELECT count(DISTINCT Circuit) AS circuits, 0 AS least, 3 AS greatest, 4 AS labels FROM attr", ATTR_SQL))
def c7_properties(spark, sf):
    """Every circuit has one label, and the labels are 0 to 3."""
    label = F.col("Circuit_Cluster").cast("int")
    got = c7(spark, sf).groupBy("Circuit").agg(F.max(label).alias("l"), F.count_distinct(label).alias("n")).where("n = 1")
    return got.agg(F.count("Circuit").alias("circuits"), F.min("l").alias("least"), F.max("l").alias("greatest"), F.count_distinct("l").alias("labels"))


@query(
    "c8_cluster_aggregates",
    with_results(
        """SELECT a.Year, a.Race_Num, a.Driver, round(m.sc, 6) AS Cluster_Avg_SC_Prob, round(m.ov, 6) AS Cluster_Avg_Overtake, round(m.pl, 6) AS Cluster_Avg_PitLoss
           FROM attr a JOIN (SELECT Circuit_Cluster, avg(SC_Probability) AS sc, avg(Overtake_Difficulty) AS ov, avg(Pit_Loss_Time) AS pl FROM attr GROUP BY 1) m USING (Circuit_Cluster)""",
        ATTR_SQL,
    ),
)
def c8(spark, sf):
    out = ft.cluster_aggregates(attributed(spark, sf))
    return rounded(out.select(*ROW_KEY, "Cluster_Avg_SC_Prob", "Cluster_Avg_Overtake", "Cluster_Avg_PitLoss"))


FORM_SQL = (
    team_events_sql(["Quali_Pos", "Position"]),
    f"tl AS (SELECT Team, Year, Race_Num, {_ratio('Quali_Pos', 'Team', 3)} AS tq, {_ratio('Position', 'Team', 3)} AS tp FROM te)",
    f"dl AS (SELECT *, avg(Quali_Pos) {_over('Driver', 3)} AS dq, avg(Position) {_over('Driver', 3)} AS dp FROM panel)",
)


def short_form(spark, sf, df):
    n = event_count(spark, sf)
    metrics, windows = ["Quali_Pos", "Position"], {"short": 3}
    df = ft.driver_history(df, ft.rolling_lags("Driver", metrics, windows), n)
    return ft.team_history(df, ft.rolling_lags("Team", metrics, windows), events=n)


@query(
    "c9_driver_minus_team_form",
    with_results("SELECT Year, Race_Num, Driver, round(dq - tq, 6) AS Teammate_Gap_Quali_short, round(dp - tp, 6) AS Teammate_Gap_Race_short FROM dl JOIN tl USING (Team, Year, Race_Num)", *FORM_SQL),
)
def c9(spark, sf):
    out = ft.team_form_gap(short_form(spark, sf, panel(spark, sf)))
    return rounded(out.select(*ROW_KEY, "Teammate_Gap_Quali_short", "Teammate_Gap_Race_short"))


@query(
    "c11_weather_flags",
    with_results("SELECT Year, Race_Num, Driver, CASE WHEN Rainfall > 30 THEN 1 ELSE 0 END AS is_wet_race, abs(AirTemp - 25.0::DOUBLE) AS temp_deviation, CASE WHEN WindSpeed > 25 THEN 1 ELSE 0 END AS is_windy FROM panel"),
)
def c11(spark, sf):
    return ft.weather_flags(panel(spark, sf)).select(*ROW_KEY, "is_wet_race", "temp_deviation", "is_windy")


@query("c12_season_progress", with_results("SELECT Year, Race_Num, Driver, round(Race_Num / max(Race_Num) OVER (PARTITION BY Year), 6) AS Season_Progress FROM panel"))
def c12(spark, sf):
    return rounded(ft.season_progress(panel(spark, sf)).select(*ROW_KEY, "Season_Progress"))


@query("c14_gap_to_team_best", with_results("SELECT Year, Race_Num, Driver, Quali_Pos - min(Quali_Pos) OVER (PARTITION BY Year, Race_Num, Team) AS Quali_Delta_Teammate FROM panel"))
def c14(spark, sf):
    return ft.quali_gap_to_team(panel(spark, sf)).select(*ROW_KEY, "Quali_Delta_Teammate")


SECONDS = "CAST(substr({c}, 11, 2) AS DOUBLE) * 60 + CAST(substr({c}, 14) AS DOUBLE)"
SEC_SQL = f"secs AS (SELECT *, coalesce({SECONDS.format(c='Q3')}, {SECONDS.format(c='Q2')}, {SECONDS.format(c='Q1')}) AS t FROM panel)"


@query(
    "c15_gap_to_pole",
    with_results(
        """SELECT Year, Race_Num, Driver, round(t, 6) AS Quali_Time_s, round(t - min(t) OVER e, 6) AS Quali_Gap_To_Pole,
           round((t - min(t) OVER e) / min(t) OVER e, 6) AS Quali_Gap_Pct FROM secs WINDOW e AS (PARTITION BY Year, Race_Num)""",
        SEC_SQL,
    ),
)
def c15(spark, sf):
    return rounded(ft.quali_gap_to_pole(panel(spark, sf)).select(*ROW_KEY, "Quali_Time_s", "Quali_Gap_To_Pole", "Quali_Gap_Pct"))


@query("c16_grid_delta", with_results("SELECT Year, Race_Num, Driver, Position - Grid AS Grid_Delta FROM panel"))
def c16(spark, sf):
    return ft.grid_delta(panel(spark, sf)).select(*ROW_KEY, "Grid_Delta")


PCT_SQL = """
pct AS (SELECT *, (rank() OVER (ORDER BY Overtake_Difficulty) + (count(*) OVER (PARTITION BY Overtake_Difficulty) - 1) / 2.0::DOUBLE) / count(*) OVER () AS pr FROM attr)
"""


@query(
    "c18_percent_rank_adjustment",
    with_results("SELECT Year, Race_Num, Driver, round((Position - Grid) * (1.0::DOUBLE - pr), 6) AS Adj_Grid_Delta FROM pct", ATTR_SQL, PCT_SQL.strip()),
)
def c18(spark, sf):
    out = ft.adjusted_grid_delta(ft.grid_delta(attributed(spark, sf)))
    return rounded(out.select(*ROW_KEY, "Adj_Grid_Delta"))


@query(
    "c19_interactions",
    with_results(
        """SELECT Year, Race_Num, Driver, round(dp * Overtake_Difficulty, 6) AS Driver_FormShort_x_Overtake,
           round(tp * Overtake_Difficulty, 6) AS Team_FormShort_x_Overtake, round(coalesce(Grid, 0) * Track_Pos_Importance, 6) AS Grid_x_TrackImportance
           FROM attr JOIN tl USING (Team, Year, Race_Num) JOIN (SELECT Year, Race_Num, Driver, dp FROM dl) USING (Year, Race_Num, Driver)""",
        ATTR_SQL,
        *FORM_SQL,
    ),
)
def c19(spark, sf):
    out = ft.interactions(short_form(spark, sf, attributed(spark, sf)))
    return rounded(out.select(*ROW_KEY, "Driver_FormShort_x_Overtake", "Team_FormShort_x_Overtake", "Grid_x_TrackImportance"))


PLAN_COLUMNS = (
    "Driver_Avg_Position_short", "Team_Avg_Position_short", "Driver_Avg_DNF_season", "Driver_Season_Points", "Team_Season_Points",
    "Season_Progress", "Quali_Delta_Teammate", "Quali_Gap_To_Pole", "Teammate_Gap_Race_short", "Driver_Sprint_Count_Prev",
    "Driver_Cluster_Avg_Race", "Driver_Cluster_Uplift", "Adj_Grid_Delta", "Grid_x_TrackImportance", "is_wet_race",
)
PLAN_SQL = with_results(
    f"""SELECT Year, Race_Num, Driver, round(dp, 6) AS Driver_Avg_Position_short, round(tp, 6) AS Team_Avg_Position_short,
        round(d23, 6) AS Driver_Avg_DNF_season, pts AS Driver_Season_Points, tpts AS Team_Season_Points,
        round(Race_Num / max(Race_Num) OVER (PARTITION BY Year), 6) AS Season_Progress,
        Quali_Pos - min(Quali_Pos) OVER (PARTITION BY Year, Race_Num, Team) AS Quali_Delta_Teammate,
        round(t - min(t) OVER (PARTITION BY Year, Race_Num), 6) AS Quali_Gap_To_Pole, round(dp - tp, 6) AS Teammate_Gap_Race_short,
        CAST(sprints AS DOUBLE) AS Driver_Sprint_Count_Prev, round(cform, 6) AS Driver_Cluster_Avg_Race, round(uplift, 6) AS Driver_Cluster_Uplift,
        round(Grid_Delta * (1.0::DOUBLE - pr), 6) AS Adj_Grid_Delta, round(coalesce(Grid, 0) * Track_Pos_Importance, 6) AS Grid_x_TrackImportance,
        CASE WHEN Rainfall > 30 THEN 1 ELSE 0 END AS is_wet_race
        FROM big JOIN tbig USING (Team, Year, Race_Num)""",
    ATTR_SQL,
    PCT_SQL.strip(),
    f"""big AS (SELECT *, Position - Grid AS Grid_Delta, coalesce({SECONDS.format(c='Q3')}, {SECONDS.format(c='Q2')}, {SECONDS.format(c='Q1')}) AS t,
        avg(Position) {_over('Driver', 3)} AS dp, avg(DNF) {_over('Driver', 23)} AS d23,
        coalesce(sum(Points) {_over('Year, Driver', 'UNBOUNDED')}, 0.0::DOUBLE) AS pts, sum(Is_Sprint) {_over('Driver', 'UNBOUNDED')} AS sprints,
        avg(Position) {_over('Driver, Circuit_Cluster', 5)} AS cform, avg(Position - Grid) {_over('Driver, Circuit_Cluster', 6)} AS uplift FROM pct)""",
    team_events_sql(["Position", "Points"]),
    f"tbig AS (SELECT Team, Year, Race_Num, {_ratio('Position', 'Team', 3)} AS tp, coalesce(sum(s_Points) {_over('Year, Team', 'UNBOUNDED')}, 0.0::DOUBLE) AS tpts FROM te)",
)


@query("c21_feature_plan", PLAN_SQL)
def c21(spark, sf):
    """All steps as one plan over the whole panel, with the fixed cluster."""
    out = build_features(panel(spark, sf), inputs=FeatureInputs(circuits=circuits(spark, sf), categories=CATEGORIES))
    return rounded(out.select(*ROW_KEY, *PLAN_COLUMNS))


@query(
    "c22_preparation",
    with_results(
        """SELECT Year, Race_Num, Driver, Team, CASE WHEN Driver % 4 = 0 THEN Position - 0.5 ELSE Position END AS Position, Quali_Pos,
           coalesce(Grid, Quali_Pos) AS Grid, DNF, CASE WHEN Quali_Pos IS NOT NULL THEN Q3 END AS Q3 FROM panel"""
    ),
)
def c22(spark, sf):
    """A quarter of the results is loaded again under the same date, with another position."""
    first = races(spark, sf).withColumn("load_seq", F.lit(1))
    again = first.where("Driver % 4 = 0").withColumns({"Position": F.col("Position") - 0.5, "load_seq": F.lit(2)})
    out = prepare(again.unionByName(first), qualifying(spark, sf).withColumn("load_seq", F.lit(1)), load_order=("load_seq",))
    return out.select(*ROW_KEY, "Team", "Position", "Quali_Pos", "Grid", "DNF", "Q3")
