"""Aggregation of trial tables: (trial_id, Driver, raw) with lower raw finishing first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankpanel.functions.columns import clamp, points_for
from rankpanel.operators.ordering import exact_quantiles, row_numbers

# Retirement probability where none is known; width of an 80 % interval in deviations, default and range.
DEFAULT_DNF_PROBABILITY = 0.08
INTERVAL_WIDTH, DEFAULT_SPREAD, SPREAD_RANGE = 2.56, 2.0, (0.5, 5.0)


def interval_sigma(low: Column, high: Column) -> Column:
    """Spread of an 80 % interval, 2.0 when a bound is missing, within [0.5, 5]."""
    ok = low.isNotNull() & high.isNotNull() & ~F.isnan(low) & ~F.isnan(high)
    return clamp(F.when(ok, (high - low) / INTERVAL_WIDTH).otherwise(F.lit(DEFAULT_SPREAD)), *SPREAD_RANGE)


def lookup_probability(df: DataFrame, probs: DataFrame, out: str = "dnf_prob", default: float = DEFAULT_DNF_PROBABILITY) -> DataFrame:
    """Probability per driver, clamped to [0, 1]; the default where none is given."""
    side = probs.select("Driver", F.col("prob").alias("_p"))
    return df.join(side, "Driver", "left").select(*df.columns, F.coalesce(clamp(F.col("_p"), 0.0, 1.0), F.lit(default)).alias(out))


def finish_ranks(trials: DataFrame, raw: str = "raw", out: str = "pos") -> DataFrame:
    return row_numbers(trials, ["trial_id"], [F.col(raw), F.col("Driver")], out)


def outcome_summary(ranked: DataFrame) -> DataFrame:
    """Win, podium and top-10 share, expected points and position percentiles per driver."""
    pos = F.col("pos")

    def pct(cond: Column) -> Column:
        return F.round(F.avg(F.when(cond, 100.0).otherwise(0.0)), 2)

    shares = ranked.groupBy("Driver").agg(
        pct(pos == 1).alias("Win_Pct"),
        pct(pos <= 3).alias("Podium_Pct"),
        pct(pos <= 10).alias("Top10_Pct"),
        F.round(F.avg(points_for(pos)), 2).alias("Exp_Points"),
    )
    spread = exact_quantiles(ranked, "pos", {"Pos_P10": 0.1, "Pos_P50": 0.5, "Pos_P90": 0.9}, ["Driver"])
    rounded = spread.select("Driver", *[F.round(c, 1).alias(c) for c in ("Pos_P10", "Pos_P50", "Pos_P90")])
    return shares.join(rounded, "Driver", "left")


def position_matrix(ranked: DataFrame, positions: int = 20) -> DataFrame:
    """Share of trials per position, one column each."""
    cols = [F.avg(F.when(F.col("pos") == p, 1.0).otherwise(0.0)).alias(f"P{p}") for p in range(1, positions + 1)]
    return ranked.groupBy("Driver").agg(*cols)


def expected_order(matrix: DataFrame, positions: int = 20) -> DataFrame:
    """Drivers by the probability-weighted position."""
    total = F.lit(0.0)
    for p in range(1, positions + 1):
        total = total + F.col(f"P{p}") * float(p)
    return matrix.select("Driver", total.alias("Exp_Pos")).orderBy("Exp_Pos", "Driver")


def check_inputs(predictions: DataFrame, sc_probability: float, required: tuple[str, ...] = ("Driver", "Predicted_Race_Pos")) -> None:
    """Raise ValueError on unusable input; one aggregate pass."""
    missing = [c for c in required if c not in predictions.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if not 0.0 <= sc_probability <= 1.0:
        raise ValueError("sc_probability must be in [0, 1]")
    usable = F.col("Predicted_Race_Pos").isNotNull() & ~F.isnan("Predicted_Race_Pos")
    row = predictions.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(usable, 1)).alias("ok")).first()
    if row["n"] == 0:
        raise ValueError("no predictions")
    if row["ok"] == 0:
        raise ValueError("all predicted positions are missing")
