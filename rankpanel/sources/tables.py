"""Test-data tables and the panel derived from them.

The panel ("results") has one row per (Year, Race_Num, Driver). It is built
once per session and input folder, written as Parquet partitioned by ``Year``
in the checkpoint folder, and scanned from there, so later queries prune
columns and partitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankpanel.functions.columns import points_for
from rankpanel.operators.ordering import group_sizes, row_numbers
from rankpanel.session import materialize

EVENT = ["Year", "Race_Num"]
ROW_KEY = ["Year", "Race_Num", "Driver"]

_stored: dict[tuple[str, ...], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(
    spark: SparkSession,
    sf_dir: str,
    name: str,
    build: Callable[[], DataFrame],
    partition_by: tuple[str, ...] = (),
) -> DataFrame:
    """Build once per session and folder, then scan the written table; tables of different builders never meet."""
    key = (spark.sparkContext.applicationId, sf_dir, name, build.__module__, build.__qualname__)
    if key not in _stored:
        _stored[key] = materialize(build(), name, partition_by)
    return _stored[key]


def _clock(ms: Column) -> Column:
    """Milliseconds as ``0 days 00:01:SS.mmm000``."""
    seconds = F.floor(ms / 1000) - 60
    return F.format_string("0 days 00:01:%02d.%03d000", seconds, ms % 1000)


def build_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly supplier revenue as event results: aggregate first, then join dimensions."""
    monthly = (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.year("l_shipdate").alias("Year"),
            F.month("l_shipdate").alias("Race_Num"),
            F.col("l_suppkey").alias("Driver"),
        )
        .agg(
            F.floor(F.sum(F.col("l_quantity").cast("decimal(18,2)"))).cast("long").alias("q"),
            F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("rev"),
            F.count(F.lit(1)).alias("Laps"),
        )
    )
    monthly = materialize(monthly, "monthly")
    sizes = group_sizes(monthly, EVENT)
    for out, first in (("Position", F.col("rev").desc()), ("_quali", F.col("q").desc()), ("_grid", F.col("Laps").desc())):
        monthly = row_numbers(monthly, EVENT, [first, F.col("Driver")], out, sizes)
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("Driver"), "s_nationkey")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("Team"))
    y, m, d, q = F.col("Year"), F.col("Race_Num"), F.col("Driver"), F.col("q")
    ms = F.lit(90000) + (q * 37 + d * 11) % 5000
    position = F.col("Position").cast("double")
    return monthly.join(suppliers, "Driver").join(nations, "s_nationkey").select(
        "Year",
        "Race_Num",
        "Driver",
        "Team",
        F.concat(F.lit("C"), F.lpad(m.cast("string"), 2, "0"), F.when(m % 2 == 0, " Grand Prix").otherwise("")).alias("Circuit"),
        F.make_date(y, m, F.lit(1)).alias("Date"),
        position.alias("Position"),
        F.when((d + m) % 17 != 0, F.col("_quali").cast("double")).alias("Quali_Pos"),
        F.when((d + m) % 13 != 0, F.col("_grid").cast("double")).alias("Grid"),
        F.when(q % 7 == 0, "Engine").when(q % 7 == 1, "+1 Lap").otherwise("Finished").alias("Status"),
        "Laps",
        points_for(position).alias("Points"),
        (F.lit(15) + (m * 7 + y) % 25).alias("AirTemp"),
        (F.lit(40) + (m * 5 + y) % 50).alias("Humidity"),
        (F.lit(1000) + (m + y) % 30).alias("Pressure"),
        ((m * 11 + y) % 50).alias("WindSpeed"),
        ((m * 13 + y) % 100).alias("Rainfall"),
        (m % 4 == 0).cast("int").alias("Is_Sprint"),
        _clock(ms + 2000).alias("Q1"),
        F.when(d % 5 != 0, _clock(ms + 1000)).alias("Q2"),
        F.when((d % 5 != 0) & (d % 3 != 0), _clock(ms)).alias("Q3"),
        F.col("rev").cast("double").alias("Revenue"),
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "results", lambda: build_results(spark, sf_dir), ("Year",))


def races(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The race side of the panel, without qualifying columns."""
    return results(spark, sf_dir).drop("Quali_Pos", "Q1", "Q2", "Q3", "Revenue")


def qualifying(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The qualifying side: rows exist only where a qualifying position does."""
    return (
        results(spark, sf_dir)
        .where(F.col("Quali_Pos").isNotNull())
        .select("Year", "Race_Num", "Circuit", "Date", "Driver", "Team", F.col("Quali_Pos").alias("Position"), "Q1", "Q2", "Q3", "Is_Sprint")
    )


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: round, name, date and format."""
    return stored(
        spark,
        sf_dir,
        "schedule",
        lambda: results(spark, sf_dir)
        .groupBy("Year", "Race_Num")
        .agg(F.min("Circuit").alias("EventName"), F.min("Date").alias("EventDate"), F.max("Is_Sprint").alias("_s"))
        .select(
            "Year",
            F.col("Race_Num").alias("RoundNumber"),
            "EventName",
            "EventDate",
            F.when(F.col("_s") == 1, "Sprint_Qualifying").otherwise("conventional").alias("EventFormat"),
        ),
    )


def ingestion_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events already loaded: two of three rounds."""
    return (
        schedule(spark, sf_dir)
        .where(F.col("RoundNumber") % 3 != 0)
        .select("Year", F.col("RoundNumber").alias("Race_Num"), F.lit("R").alias("session"))
    )


def laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as laps: numbered per (event, Driver) by order key and line."""
    li = table(spark, sf_dir, "lineitem").select(
        F.year("l_shipdate").alias("Year"),
        F.month("l_shipdate").alias("Race_Num"),
        F.col("l_suppkey").alias("Driver"),
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_linenumber") % 7 != 0, F.lit(60.0) + F.col("l_extendedprice") / 10000.0).alias("LapTime_s"),
        F.col("l_returnflag").alias("Compound"),
    )
    numbered = row_numbers(li, ROW_KEY, [F.col("l_orderkey"), F.col("l_linenumber"), F.col("LapTime_s"), F.col("Compound")], "LapNumber")
    third = F.col("LapTime_s") / 3.0
    return numbered.select(
        *ROW_KEY,
        "LapNumber",
        "LapTime_s",
        F.when(F.col("l_linenumber") % 5 != 0, third).alias("Sector1_s"),
        third.alias("Sector2_s"),
        F.when(F.col("l_linenumber") % 3 != 0, third).alias("Sector3_s"),
        "Compound",
        F.col("l_linenumber").alias("TyreLife"),
    )


def event_dimension(panel: DataFrame) -> DataFrame:
    """Distinct events with a dense ``event_idx`` from 1.

    Numbered inside each year and shifted by earlier years' counts, so the only
    unpartitioned window runs over one row per year.
    """
    events = panel.select(*EVENT).distinct()
    per_year = events.groupBy("Year").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("Year").rowsBetween(Window.unboundedPreceding, -1)
    shift = per_year.select("Year", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    within = F.row_number().over(Window.partitionBy("Year").orderBy("Race_Num"))
    return events.withColumn("_i", within).join(shift, "Year").select(*EVENT, (F.col("_i") + F.col("_shift")).alias("event_idx"))
