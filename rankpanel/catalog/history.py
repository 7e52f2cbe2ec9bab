"""Lagged history of drivers and teams."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankpanel.catalog.base import event_count, panel, query, rounded, with_results
from rankpanel.operators import features as ft
from rankpanel.operators.timeline import Ewm, lagged_ewm
from rankpanel.sources.tables import ROW_KEY, table

# Weighted means with alpha 1/2 are often exact halves of the last digit; added
# before rounding on both sides, this makes them round alike.
NUDGE = 1e-9

W = "PARTITION BY {key} ORDER BY Year, Race_Num ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING"


def _over(key: str, n) -> str:
    return f"OVER ({W.format(key=key, n=n)})"


def _driver_rolling_sql(metrics=ft.METRICS, windows=ft.WINDOWS) -> str:
    cols = [f"round(avg({m}) {_over('Driver', k)}, 6) AS Driver_Avg_{m}_{w}" for m in metrics for w, k in windows.items()]
    return with_results("SELECT Year, Race_Num, Driver, " + ", ".join(cols) + " FROM panel")


def team_events_sql(metrics, extra="") -> str:
    cols = ", ".join(f"sum({m}) AS s_{m}, count({m}) AS n_{m}, avg({m}) AS a_{m}" for m in metrics)
    return f"te AS (SELECT Team, Year, Race_Num{extra}, {cols} FROM panel GROUP BY ALL)"


def _team_rolling_sql(metrics=ft.METRICS, windows=ft.WINDOWS) -> str:
    cols = [
        f"round(sum(s_{m}) {_over('Team', k)} / nullif(sum(n_{m}) {_over('Team', k)}, 0), 6) AS Team_Avg_{m}_{w}"
        for m in metrics
        for w, k in windows.items()
    ]
    lag = "lagged AS (SELECT Team, Year, Race_Num, " + ", ".join(cols) + " FROM te)"
    return with_results("SELECT p.Driver, l.* FROM panel p JOIN lagged l USING (Team, Year, Race_Num)", team_events_sql(metrics), lag)


def _ewm_expr(source: str, key: str, span: float) -> str:
    a = 2.0 / (span + 1)
    items = f"list({{'m': CAST({source} AS DOUBLE), 'w': 1.0::DOUBLE}}) {_over(key, 'UNBOUNDED')}"
    keep = f"(a.w * {1 - a!r}::DOUBLE)"
    step = (
        f"CASE WHEN a.m IS NULL THEN {{'m': x.m, 'w': 1.0::DOUBLE}} "
        f"WHEN x.m IS NULL THEN {{'m': a.m, 'w': {keep}}} "
        f"ELSE {{'m': ({keep} * a.m + {a!r}::DOUBLE * x.m) / ({keep} + {a!r}::DOUBLE), 'w': 1.0::DOUBLE}} END"
    )
    return f"round((list_reduce({items}, lambda a, x: {step})).m + {NUDGE}::DOUBLE, 6)"


def _driver_ewm_sql() -> str:
    cols = [f"{_ewm_expr(m, 'Driver', k)} AS Driver_EWM_{m}_{s}" for m in ft.METRICS for s, k in ft.WINDOWS.items()]
    return with_results("SELECT Year, Race_Num, Driver, " + ", ".join(cols) + " FROM panel")


def _team_ewm_sql() -> str:
    cols = [f"{_ewm_expr(f'a_{m}', 'Team', k)} AS Team_EWM_{m}_{s}" for m in ft.METRICS for s, k in ft.WINDOWS.items()]
    lag = "lagged AS (SELECT Team, Year, Race_Num, " + ", ".join(cols) + " FROM te)"
    return with_results("SELECT p.Driver, l.* FROM panel p JOIN lagged l USING (Team, Year, Race_Num)", team_events_sql(ft.METRICS), lag)


def _nudged(df, lags):
    return df.withColumns({x.out: F.col(x.out) + NUDGE for x in lags})


def _driver(spark, sf, lags):
    out = ft.driver_history(panel(spark, sf), lags, event_count(spark, sf))
    return rounded(out.select(*ROW_KEY, *[x.out for x in lags]))


def _team(spark, sf, lags):
    out = ft.team_history(panel(spark, sf), lags, events=event_count(spark, sf))
    return rounded(out.select(*ROW_KEY, "Team", *[x.out for x in lags]))


@query("c1_driver_rolling_means", _driver_rolling_sql())
def c1(spark, sf):
    return _driver(spark, sf, ft.rolling_lags("Driver"))


@query("c2_team_rolling_means", _team_rolling_sql())
def c2(spark, sf):
    return _team(spark, sf, ft.rolling_lags("Team"))


@query("c3_driver_ewm", _driver_ewm_sql())
def c3(spark, sf):
    lags = ft.ewm_lags("Driver")
    out = ft.driver_history(panel(spark, sf), lags, event_count(spark, sf))
    return rounded(_nudged(out, lags).select(*ROW_KEY, *[x.out for x in lags]))


@query("c4_team_ewm", _team_ewm_sql())
def c4(spark, sf):
    lags = ft.ewm_lags("Team")
    out = ft.team_history(panel(spark, sf), lags, events=event_count(spark, sf))
    return rounded(_nudged(out, lags).select(*ROW_KEY, "Team", *[x.out for x in lags]))


DAILY = {"quantity": "l_quantity", "price": "l_extendedprice / 1000", "discount": "l_discount"}
SPANS = (3, 5, 10, 23)


def _daily_ewm_sql(entity: str) -> str:
    """The recurrence unrolled: a value ``k`` days old weighs ``a * (1 - a)^k``, the first one without the ``a``."""
    means = ", ".join(f"avg({c}) AS {m}" for m, c in DAILY.items())
    cells = ", ".join(
        f"round(sum(h.{m} * CASE WHEN h.n = 1 THEN 1 ELSE {2 / (s + 1)!r} END * pow({1 - 2 / (s + 1)!r}, d.n - 1 - h.n)) + {NUDGE}, 6) AS {m}_{s}" for m in DAILY for s in SPANS
    )
    return f"""WITH daily AS (SELECT {entity} AS entity, CAST(l_shipdate AS DATE) AS day, {means} FROM lineitem GROUP BY 1, 2),
        d AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY day) AS n FROM daily)
        SELECT d.entity, CAST(d.day AS VARCHAR) AS day, {cells} FROM d LEFT JOIN d h ON h.entity = d.entity AND h.n < d.n GROUP BY 1, 2"""


def _daily_ewm(spark, sf, entity: str):
    lines = table(spark, sf, "lineitem").groupBy(F.expr(entity).alias("entity"), F.col("l_shipdate").cast("date").alias("day"))
    daily = lines.agg(*[F.avg(F.expr(c)).alias(m) for m, c in DAILY.items()])
    ewms = [Ewm(f"{m}_{s}", m, s) for m in DAILY for s in SPANS]
    out = lagged_ewm(daily, ["entity"], ewms, ["day"])
    return rounded(out.select("entity", F.col("day").cast("string").alias("day"), *[(F.col(e.out) + NUDGE).alias(e.out) for e in ewms]))


@query("c3_driver_ewm_daily", _daily_ewm_sql("l_suppkey % 7"))
def c3_daily(spark, sf):
    """Histories of about 2,500 daily events: beyond what one window of scaled terms can hold."""
    return _daily_ewm(spark, sf, "l_suppkey % 7")


@query("c4_team_ewm_daily", _daily_ewm_sql("concat(l_returnflag, l_linestatus)"))
def c4_daily(spark, sf):
    return _daily_ewm(spark, sf, "concat(l_returnflag, l_linestatus)")


@query(
    "c10_driver_sprint_count",
    with_results(f"SELECT Year, Race_Num, Driver, CAST(sum(Is_Sprint) {_over('Driver', 'UNBOUNDED')} AS DOUBLE) AS Driver_Sprint_Count_Prev FROM panel"),
)
def c10(spark, sf):
    return _driver(spark, sf, ft.sprint_lags("Driver"))


@query(
    "c10_team_sprint_count",
    with_results(
        "SELECT p.Driver, l.* FROM panel p JOIN lagged l USING (Team, Year, Race_Num)",
        team_events_sql(["Is_Sprint"]),
        f"lagged AS (SELECT Team, Year, Race_Num, CAST(sum(s_Is_Sprint) {_over('Team', 'UNBOUNDED')} AS DOUBLE) AS Team_Sprint_Count_Prev FROM te)",
    ),
)
def c10_team(spark, sf):
    return _team(spark, sf, ft.sprint_lags("Team"))


@query(
    "c13_driver_cluster_form",
    with_results(
        f"""SELECT Year, Race_Num, Driver, round(avg(Quali_Pos) {_over('Driver, Circuit_Cluster', 5)}, 6) AS Driver_Cluster_Avg_Quali,
            round(avg(Position) {_over('Driver, Circuit_Cluster', 5)}, 6) AS Driver_Cluster_Avg_Race FROM panel"""
    ),
)
def c13(spark, sf):
    return _driver(spark, sf, ft.cluster_lags("Driver"))


def _ratio(m, key, n):
    return f"sum(s_{m}) {_over(key, n)} / nullif(sum(n_{m}) {_over(key, n)}, 0)"


@query(
    "c13_team_cluster_form",
    with_results(
        "SELECT p.Driver, l.* FROM panel p JOIN lagged l USING (Team, Year, Race_Num)",
        team_events_sql(["Quali_Pos", "Position"], ", Circuit_Cluster"),
        f"""lagged AS (SELECT Team, Year, Race_Num, round({_ratio('Quali_Pos', 'Team, Circuit_Cluster', 5)}, 6) AS Team_Cluster_Avg_Quali,
            round({_ratio('Position', 'Team, Circuit_Cluster', 5)}, 6) AS Team_Cluster_Avg_Race FROM te)""",
    ),
)
def c13_team(spark, sf):
    return _team(spark, sf, ft.cluster_lags("Team"))


DELTA = "deltas AS (SELECT *, Position - Grid AS Grid_Delta FROM panel)"


@query(
    "c17_driver_cluster_uplift",
    with_results(f"SELECT Year, Race_Num, Driver, round(avg(Grid_Delta) {_over('Driver, Circuit_Cluster', 6)}, 6) AS Driver_Cluster_Uplift FROM deltas", DELTA),
)
def c17(spark, sf):
    lags = ft.uplift_lags("Driver")
    out = ft.driver_history(ft.grid_delta(panel(spark, sf)), lags, event_count(spark, sf))
    return rounded(out.select(*ROW_KEY, "Driver_Cluster_Uplift"))


@query(
    "c17_team_cluster_uplift",
    with_results(
        "SELECT p.Driver, l.* FROM panel p JOIN lagged l USING (Team, Year, Race_Num)",
        DELTA,
        team_events_sql(["Grid_Delta"], ", Circuit_Cluster").replace("FROM panel", "FROM deltas"),
        f"lagged AS (SELECT Team, Year, Race_Num, round({_ratio('Grid_Delta', 'Team, Circuit_Cluster', 6)}, 6) AS Team_Cluster_Uplift FROM te)",
    ),
)
def c17_team(spark, sf):
    lags = ft.uplift_lags("Team")
    out = ft.team_history(ft.grid_delta(panel(spark, sf)), lags, events=event_count(spark, sf))
    return rounded(out.select(*ROW_KEY, "Team", "Team_Cluster_Uplift"))


@query(
    "c20_driver_season_points",
    with_results(f"SELECT Year, Race_Num, Driver, coalesce(sum(Points) {_over('Year, Driver', 'UNBOUNDED')}, 0.0::DOUBLE) AS Driver_Season_Points FROM panel"),
)
def c20(spark, sf):
    return _driver(spark, sf, ft.championship_lags("Driver"))


@query(
    "c20_team_season_points",
    with_results(
        "SELECT p.Driver, l.* FROM panel p JOIN lagged l USING (Team, Year, Race_Num)",
        team_events_sql(["Points"]),
        f"lagged AS (SELECT Team, Year, Race_Num, coalesce(sum(s_Points) {_over('Year, Team', 'UNBOUNDED')}, 0.0::DOUBLE) AS Team_Season_Points FROM te)",
    ),
)
def c20_team(spark, sf):
    return _team(spark, sf, ft.championship_lags("Team"))
