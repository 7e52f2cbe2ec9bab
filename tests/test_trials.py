from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rankpanel.functions.columns import normal_cdf, points_for
from rankpanel.operators import trials


@pytest.fixture(scope="module")
def ranked(spark):
    """200 trials of 20 drivers, raw scores from a hash."""
    noise = F.pmod(F.xxhash64("trial_id", "Driver"), F.lit(1000)) / 100.0
    base = spark.range(200).withColumnRenamed("id", "trial_id").withColumn("Driver", F.explode(F.sequence(F.lit(1), F.lit(20))))
    return trials.finish_ranks(base.withColumn("raw", F.col("Driver") + noise)).cache()


def test_matrix_rows_sum_to_one(ranked):
    total = sum(F.col(f"P{p}") for p in range(1, 21))
    assert trials.position_matrix(ranked).where(F.abs(total - 1) > 1e-9).isEmpty()


def test_shares(ranked):
    out = trials.outcome_summary(ranked)
    assert out.agg(F.sum("Win_Pct")).first()[0] == pytest.approx(100, abs=0.5)
    assert out.where("Podium_Pct < Win_Pct OR Top10_Pct < Podium_Pct OR Pos_P10 > Pos_P90").isEmpty()


def test_every_trial_has_each_position_once(ranked):
    assert ranked.groupBy("trial_id").agg(F.countDistinct("pos").alias("n"), F.max("pos").alias("m")).where("n <> 20 OR m <> 20").isEmpty()


def test_expected_order_follows_strength(ranked):
    order = [r["Driver"] for r in trials.expected_order(trials.position_matrix(ranked)).collect()]
    assert set(order[:5]) <= set(range(1, 10)) and set(order[-5:]) <= set(range(12, 21))


def test_points_table(spark):
    got = [r[0] for r in spark.range(1, 13).select(points_for(F.col("id"))).collect()]
    assert got == [25, 18, 15, 12, 10, 8, 6, 4, 2, 1, 0, 0]


def test_sigma(spark):
    df = spark.createDataFrame([(1.0, 3.56), (1.0, 1.0), (1.0, 99.0), (None, 2.0), (float("nan"), 2.0)], "lo double, hi double")
    got = [r[0] for r in df.select(trials.interval_sigma(F.col("lo"), F.col("hi"))).collect()]
    assert got == pytest.approx([1.0, 0.5, 5.0, 2.0, 2.0])


def test_normal_cdf(spark):
    df = spark.createDataFrame([(-1.96,), (0.0,), (1.0,)], "z double")
    assert [r[0] for r in df.select(normal_cdf(F.col("z"))).collect()] == pytest.approx([0.0249979, 0.5, 0.8413447], abs=2e-7)


@pytest.mark.parametrize(
    "rows,schema,sc",
    [
        ([], "Driver string, Predicted_Race_Pos double", 0.3),
        ([("A",)], "Driver string", 0.3),
        ([("A", None)], "Driver string, Predicted_Race_Pos double", 0.3),
        ([("A", 1.0)], "Driver string, Predicted_Race_Pos double", 1.5),
    ],
)
def test_bad_inputs_raise(spark, rows, schema, sc):
    with pytest.raises(ValueError):
        trials.check_inputs(spark.createDataFrame(rows, schema), sc)
