from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rankpanel.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "4", partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def small_groups(spark):
    """Forces the block-wise plans and plain joins."""
    spark.conf.set("spark.rankpanel.maxGroupRows", "7")
    spark.conf.set("spark.rankpanel.maxBroadcastCells", "0")
    yield
    spark.conf.unset("spark.rankpanel.maxGroupRows")
    spark.conf.unset("spark.rankpanel.maxBroadcastCells")


@pytest.fixture(scope="session")
def races(spark):
    """40 rows: two seasons of 20 rounds, two drivers in turn."""
    rows = []
    for year in (2023, 2024):
        for rnd in range(1, 21):
            i = rnd % 2
            rows.append((year, rnd, "Bahrain Grand Prix", f"{year}-03-{rnd:02d}", ("HAM", "VER")[i], ("Mercedes", "Red Bull")[i],
                         float(rnd % 7 + 1), float((rnd * 3) % 11 + 1), "Finished", 57.0, float((25, 18)[i]), 28.0, 50.0, 1013.0, 5.0, 0.0, 0))
    return spark.createDataFrame(
        rows,
        "Year int, Race_Num int, Circuit string, Date string, Driver string, Team string, Grid double, Position double, Status string, "
        "Laps double, Points double, AirTemp double, Humidity double, Pressure double, WindSpeed double, Rainfall double, Is_Sprint int",
    )


@pytest.fixture(scope="session")
def qualifying(spark, races):
    from pyspark.sql import functions as F

    return races.select(
        "Year", "Race_Num", "Circuit", "Date", "Driver", "Team", F.col("Grid").alias("Position"),
        F.lit("0 days 00:01:32.500000").alias("Q1"), F.lit("0 days 00:01:31.200000").alias("Q2"),
        F.when(F.col("Race_Num") % 2 == 0, "0 days 00:01:30.100000").alias("Q3"), "Is_Sprint",
    )
