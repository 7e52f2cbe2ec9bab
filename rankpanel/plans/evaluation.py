"""Scoring a model on history and reporting it by segment."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: segment column and the rows a group must exceed to be reported
SEGMENTS = {"Year": 0, "Driver": 5, "Circuit": 3}

METRICS = ("mae", "rmse", "bias", "std_error", "top3_accuracy", "top5_accuracy", "podium_accuracy", "weighted_mae", "sample_count")


def historical_scoring(
    history: DataFrame, features: Sequence[str], target: str, score: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Errors, tolerances, podium hits, bias and spread overall and per year, driver and circuit, in one pass by grouping sets.

    Rows without a target are dropped, absent features and nulls count as 0.
    """
    rows = history.na.drop(subset=[target])
    rows = rows.withColumns({f: F.lit(0.0) for f in features if f not in rows.columns})
    rows = rows.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features})
    scored = score(rows)
    present = [s for s in SEGMENTS if s in scored.columns]
    keyed = scored.select(F.col("pred").alias("_p"), F.col(target).cast("double").alias("_y"), *[F.col(s).cast("string").alias(s) for s in present])
    keyed = keyed.withColumn("_d", F.col("_p") - F.col("_y")).withColumn("_e", F.abs("_d"))

    def share(condition: Column) -> Column:
        return F.avg(F.when(condition, 1.0).otherwise(0.0))

    grouped = keyed.groupingSets([[], *[[s] for s in present]], *present).agg(
        F.avg("_e").alias("mae"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"), F.avg("_d").alias("bias"), F.stddev_pop("_d").alias("std_error"),
        share(F.col("_e") <= 3).alias("top3_accuracy"), share(F.col("_e") <= 5).alias("top5_accuracy"),
        share((F.col("_y") <= 3) == (F.col("_p") <= 3)).alias("podium_accuracy"),
        F.try_divide(F.sum(F.col("_e") / F.col("_y")), F.sum(1 / F.col("_y"))).alias("weighted_mae"),
        F.count(F.lit(1)).alias("sample_count"), F.grouping_id().alias("_gid"),
    )
    width = len(present)
    segment, value, least = F.lit("all"), F.lit("all"), F.lit(0)
    for i, s in enumerate(present):
        mine = F.col("_gid") == (2**width - 1) - 2 ** (width - 1 - i)
        segment = F.when(mine, s).otherwise(segment)
        value = F.when(mine, F.col(s)).otherwise(value)
        least = F.when(mine, SEGMENTS[s]).otherwise(least)
    return grouped.where(F.col("sample_count") > least).select(segment.alias("segment"), value.alias("value"), *METRICS)
