"""Registry, shared oracle CTEs and the inputs several queries use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankpanel.functions.columns import dnf_flag
from rankpanel.operators.features import Lag, driver_history
from rankpanel.sources.tables import results, schedule, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

RESULTS_SQL = """
base AS (
  SELECT CAST(year(l_shipdate) AS INTEGER) AS y, CAST(month(l_shipdate) AS INTEGER) AS m, l_suppkey AS d,
         CAST(floor(sum(CAST(l_quantity AS DECIMAL(18,2)))) AS BIGINT) AS q,
         sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS rev, count(*) AS n
  FROM lineitem GROUP BY 1, 2, 3),
ranked AS (
  SELECT *, 90000 + (q * 37 + d * 11) % 5000 AS ms,
         row_number() OVER (PARTITION BY y, m ORDER BY rev DESC, d) AS pos,
         row_number() OVER (PARTITION BY y, m ORDER BY q DESC, d) AS qpos,
         row_number() OVER (PARTITION BY y, m ORDER BY n DESC, d) AS gpos
  FROM base JOIN supplier ON s_suppkey = d JOIN nation ON n_nationkey = s_nationkey),
results AS (
  SELECT y AS Year, m AS Race_Num, d AS Driver, n_name AS Team,
         'C' || lpad(CAST(m AS VARCHAR), 2, '0') || CASE WHEN m % 2 = 0 THEN ' Grand Prix' ELSE '' END AS Circuit,
         make_date(y, m, 1) AS Date,
         CAST(pos AS DOUBLE) AS Position,
         CASE WHEN (d + m) % 17 = 0 THEN NULL ELSE CAST(qpos AS DOUBLE) END AS Quali_Pos,
         CASE WHEN (d + m) % 13 = 0 THEN NULL ELSE CAST(gpos AS DOUBLE) END AS Grid,
         CASE q % 7 WHEN 0 THEN 'Engine' WHEN 1 THEN '+1 Lap' ELSE 'Finished' END AS Status,
         n AS Laps,
         CAST(CASE pos WHEN 1 THEN 25 WHEN 2 THEN 18 WHEN 3 THEN 15 WHEN 4 THEN 12 WHEN 5 THEN 10
              WHEN 6 THEN 8 WHEN 7 THEN 6 WHEN 8 THEN 4 WHEN 9 THEN 2 WHEN 10 THEN 1 ELSE 0 END AS DOUBLE) AS Points,
         15 + (m * 7 + y) % 25 AS AirTemp, 40 + (m * 5 + y) % 50 AS Humidity, 1000 + (m + y) % 30 AS Pressure,
         (m * 11 + y) % 50 AS WindSpeed, (m * 13 + y) % 100 AS Rainfall,
         CASE WHEN m % 4 = 0 THEN 1 ELSE 0 END AS Is_Sprint,
         printf('0 days 00:01:%02d.%03d000', (ms + 2000) // 1000 - 60, (ms + 2000) % 1000) AS Q1,
         CASE WHEN d % 5 = 0 THEN NULL ELSE printf('0 days 00:01:%02d.%03d000', (ms + 1000) // 1000 - 60, (ms + 1000) % 1000) END AS Q2,
         CASE WHEN d % 5 = 0 OR d % 3 = 0 THEN NULL ELSE printf('0 days 00:01:%02d.%03d000', ms // 1000 - 60, ms % 1000) END AS Q3,
         CAST(rev AS DOUBLE) AS Revenue
  FROM ranked),
schedule AS (
  SELECT Year, Race_Num AS RoundNumber, min(Circuit) AS EventName, min(Date) AS EventDate,
         CASE WHEN max(Is_Sprint) = 1 THEN 'Sprint_Qualifying' ELSE 'conventional' END AS EventFormat
  FROM results GROUP BY 1, 2),
eventdim AS (
  SELECT Year, Race_Num, row_number() OVER (ORDER BY Year, Race_Num) AS event_idx
  FROM (SELECT DISTINCT Year, Race_Num FROM results)),
panel AS (
  SELECT *, CASE WHEN Status IN ('Finished', '+1 Lap', '+2 Laps', '+3 Laps', '+4 Laps', '+5 Laps') THEN 0 ELSE 1 END AS DNF,
         Race_Num % 4 AS Circuit_Cluster
  FROM results),
preds AS (
  SELECT Year, Race_Num, Driver, Team, Circuit, Circuit_Cluster, Is_Sprint, Position AS y,
         coalesce(Quali_Pos, 15.0::DOUBLE) AS pred, coalesce(Grid, 15.0::DOUBLE) AS p2,
         coalesce(avg(Position) OVER (PARTITION BY Driver ORDER BY Year, Race_Num ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 15.0::DOUBLE) AS p3
  FROM panel)
"""


def with_results(sql: str, *ctes: str) -> str:
    """Oracle text: the shared CTEs, any further ones, then the query."""
    return "WITH " + ",\n".join([RESULTS_SQL.strip(), *ctes]) + "\n" + sql


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: dates_as_text(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def dates_as_text(df: DataFrame) -> DataFrame:
    """Dates as ISO text, which every client reads alike."""
    new = {c: F.col(c).cast("string") for c, t in df.dtypes if t == "date"}
    return df.withColumns(new) if new else df


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column, as the oracles do."""
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with the DNF flag and a fixed cluster, the round modulo 4."""
    return results(spark, sf_dir).withColumns({"DNF": dnf_flag(F.col("Status")), "Circuit_Cluster": F.col("Race_Num") % 4})


def event_count(spark: SparkSession, sf_dir: str) -> int:
    """Events in the panel, from the stored schedule's row count."""
    return schedule(spark, sf_dir).count()


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and three scores: qualifying, grid and lagged form; stored once, as several queries read it."""

    def build() -> DataFrame:
        form = driver_history(panel(spark, sf_dir), [Lag("form", "mean", "Position", 3)], event_count(spark, sf_dir))
        fill = F.lit(15.0)
        return form.select(
            "Year", "Race_Num", "Driver", "Team", "Circuit", "Circuit_Cluster", "Is_Sprint",
            F.col("Position").alias("y"),
            F.coalesce("Quali_Pos", fill).alias("pred"),
            F.coalesce("Grid", fill).alias("p2"),
            F.coalesce("form", fill).alias("p3"),
        )

    return stored(spark, sf_dir, "predictions", build, ("Year",))
