"""Physical plans, learned models and streams."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from rankpanel.catalog import QUERIES
from rankpanel.catalog.base import panel
from rankpanel.operators import features as ft
from rankpanel.operators import metrics, splits, store
from rankpanel.plans import training
from rankpanel.sources.tables import races
from tests.conftest import SF


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_year_filter_prunes_partitions_and_columns(spark):
    text = plan(store.year_range(races(spark, SF), 1996, 1997).select("Year", "Driver", "Position"))
    assert re.search(r"PartitionFilters: \[[^\]]*Year", text)
    assert "ReadSchema: struct<Driver:bigint,Position:double>" in text


def test_all_driver_history_costs_one_shuffle_and_one_sort(spark):
    lags = ft.rolling_lags("Driver") + ft.ewm_lags("Driver") + ft.sprint_lags("Driver")
    text = plan(ft.driver_history(panel(spark, SF), lags, events=83))
    assert text.count("Exchange hashpartitioning") == 1
    assert len(re.findall(r"Sort \[", text)) == 1


def test_team_history_reaches_rows_by_broadcast(spark):
    text = plan(ft.team_history(panel(spark, SF), ft.rolling_lags("Team"), events=83))
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


@pytest.mark.parametrize("name", ["c1_driver_rolling_means", "c14_gap_to_team_best", "d8_score_ranks", "f3_finish_ranks", "g6_event_errors"])
def test_no_single_task_over_the_panel(spark, name):
    assert "SinglePartition" not in plan(QUERIES[name](spark, SF))


def test_group_metrics_combine_before_the_shuffle(spark):
    assert "partial_avg" in plan(QUERIES["g14_metrics_by_driver"](spark, SF))


@pytest.fixture(scope="module")
def matrix(spark):
    rows = panel(spark, SF).withColumn("y", F.col("Position"))
    built = ft.driver_history(rows, ft.rolling_lags("Driver", ["Position"], {"short": 3}), 83)
    return built.select("Year", "Race_Num", "Driver", "y", "Quali_Pos", "Grid", "Driver_Avg_Position_short", "DNF").cache()


FEATURES = ["Quali_Pos", "Grid", "Driver_Avg_Position_short"]


@pytest.fixture(scope="module")
def filled(matrix):
    return splits.impute_from(matrix, splits.train_medians(matrix.where("Year < 2001"), FEATURES), FEATURES).cache()


def test_pair_ranker_beats_a_constant_order(filled):
    ranker = training.fit_pair_ranker(filled.where("Year < 2001"), FEATURES)
    ranks = splits.score_ranks(ranker.transform(filled.where("Year = 2001")), "prediction", "pred")
    by_driver = splits.score_ranks(filled.where("Year = 2001").withColumn("c", F.lit(0)), "c", "pred")

    def mae(df):
        return metrics.error_metrics(df).first()["mae"]

    assert mae(ranks) < mae(by_driver)
    assert ranks.groupBy("Year", "Race_Num").agg(F.countDistinct("pred").alias("n"), F.count("*").alias("m")).where("n <> m").isEmpty()


def test_out_of_fold_covers_validation_rows_once(matrix):
    folds = splits.fold_events(matrix, 2, [2001], purge=1, embargo=1)
    models = {"linear": training.default_regressors()["linear"]}
    oof = training.out_of_fold_predictions(matrix, FEATURES, folds, models)
    expected = matrix.join(folds.where("role = 'val'"), ["Year", "Race_Num"]).count()
    assert {r["model"]: r["count"] for r in oof.groupBy("model").count().collect()} == {"linear": expected, "pair": expected}


def test_search_sorts_by_loss_and_keeps_to_the_budget(matrix):
    from pyspark.ml.regression import LinearRegression

    folds = splits.fold_events(matrix, 2, [2001])
    found = training.search_parameters(
        matrix, FEATURES, folds, lambda p: LinearRegression(labelCol="y", **p), [{"regParam": x} for x in (0.0, 1000.0, 5.0)], "mae", max_trials=2
    )
    assert len(found) == 2 and found[0][0] == {"regParam": 0.0} and found[0][1] <= found[1][1]


@pytest.mark.parametrize("method", ["isotonic", "sigmoid"])
def test_dnf_probability_is_calibrated_on_the_held_out_season(filled, method):
    model = training.fit_dnf_model(filled, FEATURES, [2000], method)
    out = model.transform(filled.where("Year = 2000")).agg(F.avg("dnf_prob").alias("p"), F.avg("DNF").alias("o"), F.min("dnf_prob").alias("lo"), F.max("dnf_prob").alias("hi")).first()
    assert out["p"] == pytest.approx(out["o"], abs=0.02) and 0 <= out["lo"] <= out["hi"] <= 1


def test_embargo_and_purge(spark):
    events = spark.createDataFrame([(2020, r) for r in range(1, 13)], "Year int, Race_Num int")
    rows = splits.fold_events(events, 5, purge=1, embargo=1).collect()
    train = {f: sorted(r["Race_Num"] for r in rows if r["fold"] == f and r["role"] == "train") for f in range(5)}
    assert train[0] == [1] and train[1] == [1, 2, 3] and train[2] == [1, 2, 3, 4]
    val = {f: sorted(r["Race_Num"] for r in rows if r["fold"] == f and r["role"] == "val") for f in range(5)}
    assert val[0] == [3, 4] and val[4] == [11, 12]


def test_few_events_reduce_the_folds(spark):
    events = spark.createDataFrame([(2020, r) for r in range(1, 4)], "Year int, Race_Num int")
    assert {r["fold"] for r in splits.fold_events(events, 5).collect()} == {0, 1}


def test_registered_scoring_queries_rank_every_entrant(spark):
    out = QUERIES["e9_batch_scoring"](spark, SF).cache()
    assert out.count() == panel(spark, SF).where("Year = 2001").count()
    assert out.where("Lower_Pos > Upper_Pos OR Prob_Podium > Prob_Top10 OR dnf_prob NOT BETWEEN 0 AND 1").isEmpty()
