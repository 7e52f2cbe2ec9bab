"""H: lap tables, derived from line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankpanel.catalog.base import query, rounded
from rankpanel.operators import laps as ops
from rankpanel.sources.tables import laps, stored

LAPS = """
WITH raw AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS Year, CAST(month(l_shipdate) AS INTEGER) AS Race_Num, l_suppkey AS Driver, l_orderkey, l_linenumber,
    CASE WHEN l_linenumber % 7 <> 0 THEN 60.0::DOUBLE + l_extendedprice / 10000.0::DOUBLE END AS t, l_returnflag AS Compound FROM lineitem),
laps AS (SELECT Year, Race_Num, Driver, t AS LapTime_s, Compound, l_linenumber AS TyreLife,
    row_number() OVER (PARTITION BY Year, Race_Num, Driver ORDER BY l_orderkey, l_linenumber, t NULLS FIRST, Compound) AS LapNumber,
    CASE WHEN l_linenumber % 5 <> 0 THEN t / 3 END AS Sector1_s, t / 3 AS Sector2_s, CASE WHEN l_linenumber % 3 <> 0 THEN t / 3 END AS Sector3_s FROM raw)
"""


def lap_table(spark, sf):
    return stored(spark, sf, "laps", lambda: laps(spark, sf))


def _first(c: str) -> str:
    return f"arg_min({c}, {{'a': LapTime_s, 'b': LapNumber}}) FILTER (WHERE {c} IS NOT NULL)"


@query(
    "h1_best_laps",
    LAPS
    + f"""SELECT Year, Race_Num, Driver, round(min(LapTime_s), 6) AS LapTime_s, round({_first('Sector1_s')}, 6) AS Sector1_s,
          round({_first('Sector2_s')}, 6) AS Sector2_s, round({_first('Sector3_s')}, 6) AS Sector3_s, {_first('Compound')} AS Compound
          FROM laps WHERE LapTime_s IS NOT NULL GROUP BY 1, 2, 3""",
)
def h1(spark, sf):
    return rounded(ops.best_laps(lap_table(spark, sf), ["Sector1_s", "Sector2_s", "Sector3_s", "Compound"]))


@query(
    "h2_fastest_lap_samples",
    LAPS
    + """, samples AS (SELECT Year, Race_Num, Driver, LapNumber, s, round(coalesce(LapTime_s, 0) + s, 6) AS speed FROM laps, range(1, 4) r(s))
         SELECT Year, Race_Num, Driver, LapNumber, s, speed FROM samples SEMI JOIN
         (SELECT Year, Race_Num, Driver, arg_min(LapNumber, {'a': LapTime_s, 'b': LapNumber}) AS LapNumber FROM laps WHERE LapTime_s IS NOT NULL GROUP BY 1, 2, 3) b
         USING (Year, Race_Num, Driver, LapNumber)""",
)
def h2(spark, sf):
    """Three samples per lap."""
    rows = lap_table(spark, sf)
    samples = rows.select("Year", "Race_Num", "Driver", "LapNumber", "LapTime_s", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("s"))
    samples = samples.select("Year", "Race_Num", "Driver", "LapNumber", "s", (F.coalesce("LapTime_s", F.lit(0.0)) + F.col("s")).alias("speed"))
    return rounded(ops.fastest_lap_samples(rows, samples))


@query("h3_lap_pace", LAPS + "SELECT Year, Race_Num, Driver, LapNumber, Compound, TyreLife, round(LapTime_s, 6) AS LapTime_s FROM laps WHERE Driver = 3")
def h3(spark, sf):
    return rounded(ops.lap_pace(lap_table(spark, sf), 3))
