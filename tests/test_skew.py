"""Block-wise plans give the rows of the plain plans, with one key holding a third of all rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankpanel.operators.ordering import average_ranks, exact_quantiles, row_numbers
from rankpanel.operators.timeline import Ewm, Frame, lagged_ewm, lagged_frames


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(7)
    n = 300
    keys = np.where(np.arange(n) % 3 == 0, 0, rng.integers(1, 9, n))
    values = rng.integers(0, 12, n).astype(float)
    values[rng.random(n) < 0.25] = np.nan
    return pd.DataFrame({"k": keys, "Year": 2000, "Race_Num": np.arange(n), "id": np.arange(n), "x": values}).astype({"Year": int})


@pytest.fixture
def frame(spark, skewed):
    df = spark.createDataFrame(skewed)
    return df.withColumn("x", F.when(~F.isnan("x"), F.col("x")))


def _sorted(df, by="id"):
    return df.toPandas().sort_values(by).reset_index(drop=True)


def test_row_numbers(frame, skewed, small_groups):
    got = _sorted(row_numbers(frame, ["k"], [F.col("x").desc_nulls_last(), F.col("id")], "r"))
    want = skewed.sort_values(["k", "x", "id"], ascending=[True, False, True], na_position="last").groupby("k").cumcount() + 1
    assert got["r"].tolist() == want.sort_index().tolist()


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("pct", [False, True])
def test_average_ranks(frame, skewed, small_groups, keys, pct):
    got = _sorted(average_ranks(frame, "x", keys, "r", pct=pct))
    want = skewed["x"].rank(pct=pct) if not keys else skewed.groupby("k")["x"].rank(pct=pct)
    pd.testing.assert_series_equal(got["r"], want, check_names=False)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_exact_quantiles(frame, skewed, small_groups, keys):
    got = exact_quantiles(frame, "x", {"lo": 0.1, "mid": 0.5, "hi": 0.9}, keys).toPandas()
    if not keys:
        assert got.loc[0].tolist() == pytest.approx(skewed["x"].quantile([0.1, 0.5, 0.9]).tolist())
        return
    want = skewed.groupby("k")["x"].quantile([0.1, 0.5, 0.9]).unstack()
    got = got.set_index("k").sort_index()
    assert np.allclose(got.to_numpy(), want.to_numpy())


@pytest.mark.parametrize("blocks", [False, True])
def test_lagged_frames(frame, skewed, blocks, request):
    if blocks:
        request.getfixturevalue("small_groups")
    frames = [Frame("m3", "avg", "x", 3), Frame("total", "sum", "x"), Frame("n", "count", "x"), Frame("prev", "max", "id", 1)]
    got = _sorted(lagged_frames(frame, ["k"], frames))
    g = skewed.groupby("k")
    m3 = g["x"].transform(lambda s: s.shift(1).rolling(3, min_periods=1).mean())
    total = g["x"].transform(lambda s: s.shift(1).fillna(0).cumsum().where(s.shift(1).notna().cumsum() > 0))
    assert np.allclose(got["m3"], m3, equal_nan=True)
    assert np.allclose(got["total"], total, equal_nan=True)
    assert got["n"].tolist() == g["x"].transform(lambda s: s.shift(1).notna().cumsum()).tolist()
    assert np.allclose(got["prev"].astype(float), g["id"].shift(1), equal_nan=True)


@pytest.mark.parametrize("blocks", [False, True])
def test_lagged_ewm_matches_pandas(frame, skewed, blocks, request):
    if blocks:
        request.getfixturevalue("small_groups")
    spans = {"e2": 2, "e3": 3, "e23": 23}
    got = _sorted(lagged_ewm(frame, ["k"], [Ewm(o, "x", s) for o, s in spans.items()]))
    for o, s in spans.items():
        want = skewed.groupby("k")["x"].transform(lambda c, s=s: c.shift(1).ewm(span=s, min_periods=1, adjust=False).mean())
        assert np.allclose(got[o], want, equal_nan=True, rtol=1e-9), o


def test_ewm_of_a_long_history_does_not_overflow(spark):
    """2,000 rows of one key: more decay than one exponent can hold."""
    n = 2000
    x = pd.Series(np.random.default_rng(3).normal(10, 3, n))
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "Year": 2000, "Race_Num": range(n), "id": range(n), "x": x}))
    got = _sorted(lagged_ewm(df, ["k"], [Ewm("e", "x", 3), Ewm("f", "x", 10)]))
    assert np.allclose(got["e"], x.shift(1).ewm(span=3, adjust=False).mean(), equal_nan=True)
    assert np.allclose(got["f"], x.shift(1).ewm(span=10, adjust=False).mean(), equal_nan=True)


def test_long_histories_take_one_pass(spark):
    """500 events and twelve columns: few scans and windows, planned quickly."""
    import time

    df = spark.range(2_000).selectExpr("id % 4 AS k", "id AS t", "rand(1) AS a", "rand(2) AS b", "rand(3) AS c")
    ewms = [Ewm(f"{m}{s}", m, s) for m in "abc" for s in (3, 5, 10, 23)]
    start = time.time()
    out = lagged_ewm(df, ["k"], ewms, ["t"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert time.time() - start < 12
    assert plan.count("FileScan") <= 3
    assert len([x for x in plan.splitlines() if "Window [" in x]) <= 6


def test_ewm_needs_a_span_above_one(frame):
    with pytest.raises(ValueError):
        lagged_ewm(frame, ["k"], [Ewm("e", "x", 1)])
