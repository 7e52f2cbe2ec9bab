"""Lap-table queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DRIVER_EVENT = ["Year", "Race_Num", "Driver"]


def best_laps(laps: DataFrame, details: Sequence[str]) -> DataFrame:
    """Best lap per driver and event; each detail is the first non-null one in lap-time order."""
    timed = laps.where(F.col("LapTime_s").isNotNull())
    order = F.struct("LapTime_s", "LapNumber")
    cols = [F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in details]
    return timed.groupBy(*DRIVER_EVENT).agg(F.min("LapTime_s").alias("LapTime_s"), *cols)


def fastest_lap_samples(laps: DataFrame, samples: DataFrame) -> DataFrame:
    """Sample rows of each driver's fastest lap."""
    best = laps.where(F.col("LapTime_s").isNotNull()).groupBy(*DRIVER_EVENT).agg(
        F.min_by("LapNumber", F.struct("LapTime_s", "LapNumber")).alias("LapNumber")
    )
    return samples.join(best, [*DRIVER_EVENT, "LapNumber"], "left_semi")


def lap_pace(laps: DataFrame, driver, seconds: Column | None = None) -> DataFrame:
    """Laps of one driver with their time in seconds."""
    time = seconds if seconds is not None else F.col("LapTime_s")
    return laps.where(F.col("Driver") == driver).select(*DRIVER_EVENT, "LapNumber", "Compound", "TyreLife", time.alias("LapTime_s"))
