"""Input modes, grids, risk, bands and the historical baseline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankpanel.functions.columns import clamp, prob_at_most
from rankpanel.operators.ordering import row_numbers

EVENT = ["Year", "Race_Num"]
KEY = ["Year", "Race_Num", "Driver"]
MODES = ("auto", "post_quali", "pre_quali", "pre_weekend")

# What an entrant without history is given.
BASELINE_DEFAULTS = {"Avg_Pos": 10.5, "Avg_Quali_Pos": 10.5, "Win_Rate": 0.0, "Podium_Rate": 0.0, "DNF_Rate": 0.2}


def choose_qualifying(roster: DataFrame, mode: str, actual: DataFrame | None = None, predicted: DataFrame | None = None) -> DataFrame:
    """Add ``Quali_Pos``, ``Post_Quali`` and ``Quali_Source`` for each event of the roster.

    ``actual`` and ``predicted`` hold (event, Driver, Quali_Pos). In ``auto`` an
    event with any actual row uses actual positions only. In ``post_quali``
    events without actual rows have no result.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "pre_weekend":
        return roster.withColumns(
            {"Quali_Pos": F.lit(None).cast("double"), "Post_Quali": F.lit(0), "Quali_Source": F.lit(None).cast("string")}
        )
    out, pos, use_actual = roster, F.lit(None).cast("double"), F.lit(False)
    if mode in ("auto", "post_quali"):
        done = actual.select(*EVENT).distinct().withColumn("_done", F.lit(True))
        out = out.join(done, EVENT, "left" if mode == "auto" else "inner")
        out = out.join(actual.select(*KEY, F.col("Quali_Pos").alias("_actual")), KEY, "left")
        use_actual = F.coalesce(F.col("_done"), F.lit(False))
        pos = F.col("_actual")
    if mode in ("auto", "pre_quali"):
        out = out.join(predicted.select(*KEY, F.col("Quali_Pos").alias("_predicted")), KEY, "left")
        pos = F.when(use_actual, pos).otherwise(F.col("_predicted"))
    return out.select(
        *roster.columns,
        pos.alias("Quali_Pos"),
        use_actual.cast("int").alias("Post_Quali"),
        F.when(use_actual, "actual").otherwise("predicted").alias("Quali_Source"),
    )


def override_grid(df: DataFrame, grid: DataFrame) -> DataFrame:
    """Actual grid where known, else the qualifying position; parc ferme follows qualifying."""
    side = grid.select(*KEY, F.col("Grid").alias("_grid"))
    out = df.drop("Grid").join(side, KEY, "left")
    return out.withColumns({"Grid": F.coalesce("_grid", "Quali_Pos"), "Parc_Ferme": F.col("Post_Quali")}).drop("_grid")


def risk_adjusted(df: DataFrame, pos: str, prob: str, out: str, by_cluster: DataFrame | None = None, default: float = 20.0) -> DataFrame:
    """(1 - p) * position + p * retirement position, the latter per cluster or the default."""
    p, where = F.col(prob), F.lit(default)
    wide = df
    if by_cluster is not None and "Circuit_Cluster" in df.columns:
        wide = df.join(by_cluster.select("Circuit_Cluster", F.col("dnf_position").cast("double").alias("_dp")), "Circuit_Cluster", "left")
        where = F.coalesce(F.col("_dp"), F.lit(default))
    return wide.select(*df.columns, ((1.0 - p) * F.col(pos) + p * where).alias(out))


def format_results(df: DataFrame, score: str, score_type: str, out: str = "Predicted_Pos", ascending: bool = True) -> DataFrame:
    """Ranked rows per event: position, entrant, score and its type."""
    order = F.col(score).asc_nulls_last() if ascending else F.col(score).desc_nulls_last()
    ranked = row_numbers(df, EVENT, [order, F.col("Driver")], out)
    return ranked.select(*EVENT, out, "Driver", "Team", F.col(score).alias("Prediction_Score"), F.lit(score_type).alias("Score_Type"))


def bands(df: DataFrame, pos: str, std: float | None = None, low: str | None = None, high: str | None = None,
          delta: float = 1.5, first: float = 1.0, last: float = 20.0) -> DataFrame:
    """Bounds from quantile columns, else position -/+ delta * std, clipped to the field."""
    lo = F.col(low) if low else F.col(pos) - delta * std
    hi = F.col(high) if high else F.col(pos) + delta * std
    return df.withColumns({"Lower_Pos": clamp(lo, first, last), "Upper_Pos": clamp(hi, first, last)})


def threshold_probabilities(df: DataFrame, pos: str, std: float, ks: dict[str, int] | None = None) -> DataFrame:
    ks = ks or {"Prob_Podium": 3, "Prob_Top10": 10}
    return df.withColumns({o: prob_at_most(k, F.col(pos), F.lit(float(std))) for o, k in ks.items()})


def baseline_form(panel: DataFrame) -> DataFrame:
    """Per driver: mean position, mean qualifying, win, podium and retirement rate."""
    pos = F.col("Position")

    def rate(cond):
        return F.avg(F.when(F.coalesce(cond, F.lit(False)), 1.0).otherwise(0.0))

    return panel.groupBy("Driver").agg(
        F.avg(pos).alias("Avg_Pos"),
        F.avg("Quali_Pos").alias("Avg_Quali_Pos"),
        rate(pos == 1).alias("Win_Rate"),
        rate(pos <= 3).alias("Podium_Rate"),
        F.avg(F.col("DNF").cast("double")).alias("DNF_Rate"),
    )


def baseline_order(roster: DataFrame, panel: DataFrame, session: str = "race", keys: Sequence[str] = EVENT) -> DataFrame:
    """Order a roster by historical means; unknown entrants get the defaults."""
    joined = roster.join(baseline_form(panel), "Driver", "left")
    filled = joined.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in BASELINE_DEFAULTS.items()})
    by = "Avg_Quali_Pos" if session == "qualifying" else "Avg_Pos"
    filled = filled.withColumn("Prediction_Score", F.col("Win_Rate") + F.col("Podium_Rate") - F.col("DNF_Rate"))
    ranked = row_numbers(filled, keys, [F.round(by, 9), F.col("Driver")], "Predicted_Pos")
    return ranked.select(*keys, "Driver", "Team", "Predicted_Pos", "Prediction_Score")
