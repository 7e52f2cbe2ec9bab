"""Scoring of upcoming events: features, contract, models, ranks, risk, bands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankpanel.operators import scoring, splits
from rankpanel.operators.clean import enforce_contract, expand_roster
from rankpanel.plans import training
from rankpanel.plans.features import FeatureInputs, build_features
from rankpanel.session import materialize

EVENT = ["Year", "Race_Num"]
KEY = ["Year", "Race_Num", "Driver"]
STEPS = ("rolling", "sprint", "championship", "cluster_form", "season_progress", "weather", "quali_delta", "grid_uplift")
WINDOWS = {"short": 3, "long": 10}


def feature_matrix(panel: DataFrame, target: str) -> tuple[DataFrame, list[str]]:
    """(key, Team, DNF, y, features) without same-event outcomes."""
    built = build_features(panel, STEPS, FeatureInputs(windows=WINDOWS))
    safe = splits.drop_outcomes(built, target, [*KEY, "Team"])
    numbers = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    numeric = [c for c, t in safe.dtypes if t.partition("(")[0] in numbers and c not in KEY]
    kept = built.select(*KEY, "Team", F.col("DNF"), F.col(target).alias("y"), *[F.col(c).cast("double").alias(c) for c in numeric])
    return kept, numeric


def score_events(panel: DataFrame, schedule: DataFrame, target: str, train_before: int, band_delta: float = 1.5) -> DataFrame:
    """Rank the entrants of every event from ``train_before`` on, in one plan.

    Features of an event use earlier events only, so all target events are
    scored together. ``target`` is ``qualifying`` or ``race``; race positions
    are risk-adjusted and get bands and threshold probabilities.
    """
    label = "Quali_Pos" if target == "qualifying" else "Position"
    matrix, features = feature_matrix(panel, label)
    matrix = materialize(matrix, "matrix")
    history = matrix.where((F.col("Year") < train_before) & F.col("y").isNotNull())
    medians = splits.train_medians(history, features)
    # one value per feature: the feature list bounds what is collected
    defaults = {r["feature"]: r["median"] for r in medians.collect()}
    train = materialize(enforce_contract(history, features, defaults, keep=[*KEY, "y", "DNF"]), "train")
    entered = matrix.where(F.col("Year") >= train_before).drop("Is_Sprint")
    roster = expand_roster(schedule.where(F.col("Year") >= train_before), entered)
    upcoming = enforce_contract(roster, features, defaults, keep=[*KEY, "Team"])
    ranker = training.fit_pair_ranker(train, features)
    scored = splits.score_ranks(ranker.transform(upcoming, "score"), "score", "rank_pos")
    if target == "qualifying":
        return scored.select(*KEY, "Team", F.col("rank_pos").alias("Predicted_Quali_Pos"), F.col("score").alias("Prediction_Score"))
    dnf = training.fit_dnf_model(train, features, [train_before - 1])
    risky = scoring.risk_adjusted(dnf.transform(scored), "rank_pos", "dnf_prob", "expected")
    fitted = splits.score_ranks(ranker.transform(train, "score"), "score", "rank_pos")
    std = fitted.agg(F.stddev_pop(F.col("y") - F.col("rank_pos")).alias("s")).first()["s"] or band_delta
    banded = scoring.bands(risky, "expected", std=std, delta=band_delta)
    return scoring.threshold_probabilities(banded, "expected", std).select(
        *KEY, "Team", F.col("expected").alias("Predicted_Race_Pos"), "score", "dnf_prob", "Lower_Pos", "Upper_Pos", "Prob_Podium", "Prob_Top10"
    )
