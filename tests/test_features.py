from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rankpanel.catalog.base import panel
from rankpanel.catalog.features import CATEGORIES, circuits
from rankpanel.operators import features as ft
from rankpanel.operators import splits
from rankpanel.plans.features import FeatureInputs, build_features, prepare
from tests.conftest import SF


def test_quali_seconds_prefer_the_last_session(spark):
    df = spark.createDataFrame(
        [(2024, 1, "A", "0 days 00:01:32.500000", "0 days 00:01:31.000000", "0 days 00:01:30.000000"), (2024, 1, "B", "0 days 00:01:33.000000", None, None)],
        "Year int, Race_Num int, Driver string, Q1 string, Q2 string, Q3 string",
    )
    rows = {r["Driver"]: r for r in ft.quali_gap_to_pole(df).collect()}
    assert rows["A"]["Quali_Time_s"] == 90.0 and rows["A"]["Quali_Gap_To_Pole"] == 0.0
    assert rows["B"]["Quali_Gap_To_Pole"] == 3.0 and rows["B"]["Quali_Gap_Pct"] == pytest.approx(3 / 90)


def test_season_points_start_anew_and_lag_by_one_event(spark):
    earned = {(2030, 1): 3.5, (2030, 2): 0.0, (2030, 4): 7.0, (2031, 1): 2.0, (2031, 3): 1.0}
    rows = [(y, n, "north", 40, p) for (y, n), p in earned.items()] + [(2030, 3, "south", 40, 100.0)]
    df = spark.createDataFrame(rows, "Year int, Race_Num int, Driver string, Team int, Points double")
    got = {(r["Year"], r["Race_Num"]): r["Driver_Season_Points"] for r in ft.driver_history(df, ft.championship_lags("Driver")).where("Driver = 'north'").collect()}
    assert got == {k: sum(p for (y, n), p in earned.items() if y == k[0] and n < k[1]) for k in earned}


def test_points_after_a_missing_value_follow_the_lag_rule(spark):
    rows = [(2024, 1, "A", 10.0), (2024, 2, "A", None), (2024, 3, "A", 5.0), (2024, 4, "A", 1.0)]
    df = spark.createDataFrame(rows, "Year int, Race_Num int, Driver string, Points double")
    got = ft.driver_history(df, ft.championship_lags("Driver")).orderBy("Race_Num")
    assert [r["Driver_Season_Points"] for r in got.collect()] == [0, 10, 0, 15]


@pytest.mark.parametrize("rain,temp,wind,want", [(50.0, 25.0, 30.0, (1, 0.0, 1)), (0.0, 15.0, 5.0, (0, 10.0, 0)), (None, 30.0, None, (0, 5.0, 0))])
def test_weather_flags(spark, rain, temp, wind, want):
    df = spark.createDataFrame([(temp, 50.0, 1013.0, wind, rain)], "AirTemp double, Humidity double, Pressure double, WindSpeed double, Rainfall double")
    assert tuple(ft.weather_flags(df).select("is_wet_race", "temp_deviation", "is_windy").first()) == want


def test_weather_needs_all_columns(spark):
    df = spark.createDataFrame([(1.0,)], "AirTemp double")
    assert ft.weather_flags(df).columns == ["AirTemp"]


def test_season_progress_against_seen_and_scheduled_rounds(spark):
    df = spark.createDataFrame([(2024, r) for r in range(1, 6)], "Year int, Race_Num int")
    assert [r[2] for r in ft.season_progress(df).orderBy("Race_Num").collect()] == [0.2, 0.4, 0.6, 0.8, 1.0]
    rounds = spark.createDataFrame([(2024, 10)], "Year int, RoundNumber int")
    assert ft.season_progress(df, rounds).agg(F.max("Season_Progress")).first()[0] == 0.5


def test_first_event_has_no_form(races):
    out = ft.driver_history(races, ft.rolling_lags("Driver", ["Position"], {"short": 3}))
    first = out.where("Year = 2023 AND Race_Num <= 2")
    assert [r["Driver_Avg_Position_short"] for r in first.collect()] == [None, None]


def test_grid_delta(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 1.0)], "Grid double, Position double")
    assert sorted(r["Grid_Delta"] for r in ft.grid_delta(df).collect()) == [-1.0, 2.0]


def test_team_lag_hides_the_team_mate(spark):
    """Both cars of a team see the same team form: only earlier events count."""
    rows = [(2024, e, d, "T", float(p)) for e, (a, b) in enumerate([(1, 3), (5, 7), (2, 8)], 1) for d, p in (("A", a), ("B", b))]
    df = spark.createDataFrame(rows, "Year int, Race_Num int, Driver string, Team string, Position double")
    out = ft.team_history(df, [ft.Lag("form", "mean", "Position", 3)]).orderBy("Race_Num", "Driver")
    assert [r["form"] for r in out.collect()] == [None, None, 2.0, 2.0, 4.0, 4.0]


def test_prepare_with_empty_qualifying(spark, races):
    empty = spark.createDataFrame([], "Year int, Race_Num int, Driver string, Date date, Position double")
    out = prepare(races, empty)
    assert out.count() == 40 and out.where("Quali_Pos IS NOT NULL").count() == 0


def test_plan_keeps_rows_and_adds_features(races, qualifying):
    out = build_features(prepare(races, qualifying))
    assert out.count() == 40 and len(out.columns) > 90


def test_unknown_step_is_skipped(races, caplog):
    assert build_features(races, ["no_such_step"]).columns == races.columns
    assert "no_such_step" in caplog.text


def test_clusters_are_stable_and_fall_back(spark):
    rows = ft.category_flags(ft.circuit_attributes(panel(spark, SF).drop("Circuit_Cluster"), circuits(spark, SF)), CATEGORIES)
    a = {r[0]: r[1] for r in ft.circuit_clusters(rows).collect()}
    b = {r[0]: r[1] for r in ft.circuit_clusters(rows.repartition(3)).collect()}
    assert a == b and set(a.values()) == {0, 1, 2, 3}
    assert {r[1] for r in ft.circuit_clusters(rows, k=50).collect()} == {0}


def test_no_feature_sees_its_own_or_later_outcomes(spark):
    """Change every outcome of one event: features of that and earlier events stay."""
    inputs = FeatureInputs(circuits=circuits(spark, SF), categories=CATEGORIES)
    rows = panel(spark, SF)
    here = (F.col("Year") == 1998) & (F.col("Race_Num") == 6)
    changed = rows.withColumns(
        {
            "Position": F.when(here, 100.0 - F.col("Position")).otherwise(F.col("Position")),
            "Points": F.when(here, 7.0).otherwise(F.col("Points")),
            "DNF": F.when(here, 1 - F.col("DNF")).otherwise(F.col("DNF")),
        }
    )
    until = "Year < 1998 OR (Year = 1998 AND Race_Num <= 6)"

    def features(df):
        built = build_features(df, inputs=inputs).where(until)
        return splits.drop_outcomes(built, "Position", ["Year", "Race_Num", "Driver"])

    # rounding: sums of doubles may combine in another order
    def plain(df):
        return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])

    a, b = plain(features(rows)), plain(features(changed))
    assert "Driver_Avg_Position_short" in a.columns
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_later_events_do_see_it(spark):
    rows = panel(spark, SF)
    lag = [ft.Lag("form", "mean", "Position", 3)]
    here = (F.col("Year") == 1998) & (F.col("Race_Num") == 6)
    changed = rows.withColumn("Position", F.when(here, 1000.0).otherwise(F.col("Position")))
    later = "Year = 1998 AND Race_Num = 7"
    a = ft.driver_history(rows, lag).where(later).agg(F.sum("form")).first()[0]
    b = ft.driver_history(changed, lag).where(later).agg(F.sum("form")).first()[0]
    assert a != b
