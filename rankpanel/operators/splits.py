"""Hold-outs, folds, scaling, imputation and targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankpanel.operators.medians import medians
from rankpanel.operators.ordering import row_numbers
from rankpanel.session import join_small
from rankpanel.sources.tables import event_dimension

EVENT = ["Year", "Race_Num"]

#: Known only after the event; never model inputs.
OUTCOMES = ("Position", "Points", "Laps", "Status", "DNF", "Grid_Delta", "Adj_Grid_Delta", "Revenue")


def holdout_split(df: DataFrame, holdout_years: Sequence[int] = (), test_size: float = 0.15, seed: int = 42) -> DataFrame:
    """Add ``split``: named years are the test set, else the last share of events, else a hash of the row."""
    if holdout_years and "Year" in df.columns:
        held = F.col("Year").isin(*holdout_years)
        probe = df.select("Year").distinct().agg(F.max(held.cast("int")).alias("hi"), F.min(held.cast("int")).alias("lo")).first()
        if probe["hi"] == 1 and probe["lo"] == 0:
            return df.withColumn("split", F.when(held, "test").otherwise("train"))
    if set(EVENT) <= set(df.columns):
        events = event_dimension(df)
        cut = F.floor(events.agg(F.max("event_idx")).scalar() * F.lit(1.0 - test_size))
        sides = events.select(*EVENT, F.when(F.col("event_idx") > cut, "test").otherwise("train").alias("split"))
        return join_small(df, sides, EVENT, "sides").select(*df.columns, "split")
    share = F.pmod(F.xxhash64(*df.columns, F.lit(seed)), F.lit(10_000)) / 10_000
    return df.withColumn("split", F.when(share < test_size, "test").otherwise("train"))


def drop_outcomes(df: DataFrame, target: str, keys: Sequence[str], outcomes: Sequence[str] = OUTCOMES) -> DataFrame:
    """Leak guard: drop the target and every same-event outcome; before qualifying, its result too."""
    gone = set(outcomes) | {target}
    if target == "Quali_Pos":
        gone |= {"Grid", "Q1", "Q2", "Q3", "Q1_s", "Q2_s", "Q3_s", "Quali_Time_s", "Quali_Gap_To_Pole", "Quali_Gap_Pct", "Quali_Delta_Teammate"}
    return df.drop(*[c for c in gone if c not in keys])


def fold_events(
    df: DataFrame, n_splits: int = 5, holdout_years: Sequence[int] = (), purge: int = 0, embargo: int = 0
) -> DataFrame:
    """(event, fold, role) of grouped time-series folds, computed on the event dimension.

    Fold i trains on the first ``m (i+1) / (n+1)`` events and validates on the
    next stretch. ``purge`` drops the last training events; ``embargo`` drops
    the events that follow an earlier fold's validation window from training.
    """
    events = event_dimension(df.where(~F.col("Year").isin(*holdout_years)) if holdout_years else df)
    m = events.agg(F.max("event_idx")).scalar().cast("long")
    n = F.when(F.col("_m") < n_splits + 1, F.greatest(F.lit(1), F.col("_m") - 1)).otherwise(F.lit(n_splits))

    def end(i: Column) -> Column:
        return F.floor(F.col("_m") * (i + 1) / (F.col("_n") + 1))

    idx, fold = F.col("event_idx") - 1, F.col("fold")
    earlier = F.sequence(F.lit(1), F.lit(n_splits + 1))
    embargoed = F.exists(
        earlier, lambda j: (j <= fold) & (idx >= end(j)) & (idx < end(j) + embargo)
    )
    in_train = (idx < end(fold) - purge) & ~(embargoed if embargo else F.lit(False))
    in_val = (idx >= end(fold)) & (idx < end(fold + 1))
    return (
        events.withColumn("_m", m)
        .withColumn("_n", n)
        .withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
        .where(fold < F.col("_n"))
        .withColumn("role", F.when(in_train, "train").when(in_val, "val"))
        .where(F.col("role").isNotNull())
        .select(*EVENT, "fold", "role")
    )


def fold_rows(df: DataFrame, folds: DataFrame) -> DataFrame:
    return join_small(df, folds, EVENT, "folds", "inner")


def group_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(*EVENT).agg(F.count(F.lit(1)).alias("group_size"))


def event_zscore(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / population deviation within the event; null where the deviation is 0."""
    stats = df.groupBy(*EVENT).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns]
    )
    joined = join_small(df, stats, EVENT, "event-stats")
    z = {c: F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.nullif(F.col(f"_s_{c}"), F.lit(0.0))) for c in columns}
    return joined.select(*[z[c].alias(c) if c in z else F.col(c) for c in df.columns])


def train_medians(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, median) of the training rows, by bucket counts: no value is shuffled."""
    return medians(train, columns)


def impute_from(df: DataFrame, medians: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill nulls with the training medians, then 0."""
    wide = medians.agg(*[F.max(F.when(F.col("feature") == c, F.col("median"))).alias(c) for c in columns])
    filled = {c: F.coalesce(F.col(c).cast("double"), wide.select(c).scalar(), F.lit(0.0)) for c in columns}
    return df.withColumns(filled)


def score_ranks(df: DataFrame, score: str, out: str, keys: Sequence[str] = EVENT) -> DataFrame:
    """Best score is rank 1 within the event; ties go to the smaller Driver."""
    return row_numbers(df, keys, [F.col(score).desc_nulls_last(), F.col("Driver")], out)


def to_relevance(df: DataFrame, target: str, out: str) -> DataFrame:
    """max + 1 - y, so that higher is better."""
    return df.withColumn(out, df.agg(F.max(target)).scalar() + 1 - F.col(target))
