"""F: trial tables. Each event is a trial; higher revenue finishes first."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankpanel.catalog.base import panel, predictions, query, rounded, with_results
from rankpanel.functions.columns import points_for
from rankpanel.operators import trials
from rankpanel.sources.tables import ROW_KEY, results, stored

TRIALS = "trials AS (SELECT Year * 100 + Race_Num AS trial_id, Driver, -Revenue AS raw FROM results)"
RANKED = "ft AS (SELECT *, row_number() OVER (PARTITION BY trial_id ORDER BY raw, Driver) AS pos FROM trials)"


def ranked(spark, sf):
    def build():
        table = results(spark, sf).select((F.col("Year") * 100 + F.col("Race_Num")).alias("trial_id"), "Driver", (-F.col("Revenue")).alias("raw"))
        return trials.finish_ranks(table)

    return stored(spark, sf, "trials", build)


@query(
    "f1_interval_spread",
    with_results("SELECT Year, Race_Num, Driver, round(CASE WHEN Grid IS NULL OR Quali_Pos IS NULL THEN 2.0::DOUBLE ELSE greatest(0.5::DOUBLE, least(5.0::DOUBLE, abs(Quali_Pos - Grid) / 2.56::DOUBLE)) END, 6) AS sigma FROM panel"),
)
def f1(spark, sf):
    lo, hi = F.lit(0.0) * F.col("Grid"), F.abs(F.col("Quali_Pos") - F.col("Grid"))
    return rounded(panel(spark, sf).select(*ROW_KEY, trials.interval_sigma(lo, hi).alias("sigma")))


@query(
    "f2_probability_lookup",
    with_results(
        """SELECT p.Year, p.Race_Num, p.Driver, CASE WHEN r.p IS NULL THEN 0.08::DOUBLE ELSE round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, r.p)), 6) END AS dnf_prob
           FROM panel p LEFT JOIN (SELECT Driver, avg(DNF) * 8 - 0.5 AS p FROM panel WHERE Driver % 4 <> 0 GROUP BY 1) r USING (Driver)"""
    ),
)
def f2(spark, sf):
    """Rates stretched beyond [0, 1]; a quarter of the drivers has none."""
    rows = panel(spark, sf)
    probs = rows.where("Driver % 4 <> 0").groupBy("Driver").agg((F.avg("DNF") * 8 - 0.5).alias("prob"))
    return rounded(trials.lookup_probability(rows.select(*ROW_KEY), probs))


@query("f3_finish_ranks", with_results("SELECT trial_id, Driver, raw, pos FROM ft", TRIALS, RANKED))
def f3(spark, sf):
    table = results(spark, sf).select((F.col("Year") * 100 + F.col("Race_Num")).alias("trial_id"), "Driver", (-F.col("Revenue")).alias("raw"))
    return trials.finish_ranks(table)


@query("f4_points", with_results("SELECT Year, Race_Num, Driver, Points FROM results"))
def f4(spark, sf):
    return results(spark, sf).select(*ROW_KEY, points_for(F.col("Position")).alias("Points"))


def _dec(expr: str, digits: int) -> str:
    """Rounding as decimal, so that exact halves of two digits round up as in Spark."""
    return f"CAST(round(CAST({expr} AS DECIMAL(18,9)), {digits}) AS DOUBLE)"


POINTS_SQL = "CAST(CASE pos WHEN 1 THEN 25 WHEN 2 THEN 18 WHEN 3 THEN 15 WHEN 4 THEN 12 WHEN 5 THEN 10 WHEN 6 THEN 8 WHEN 7 THEN 6 WHEN 8 THEN 4 WHEN 9 THEN 2 WHEN 10 THEN 1 ELSE 0 END AS DOUBLE)"
SUMMARY = "SELECT Driver, " + ", ".join(
    [f"{_dec(f'avg(CASE WHEN pos <= {k} THEN 100.0::DOUBLE ELSE 0 END)', 2)} AS {o}" for o, k in (("Win_Pct", 1), ("Podium_Pct", 3), ("Top10_Pct", 10))]
    + [f"{_dec(f'avg({POINTS_SQL})', 2)} AS Exp_Points"]
    + [f"{_dec(f'quantile_cont(CAST(pos AS DOUBLE), {q})', 1)} AS Pos_P{int(q * 100)}" for q in (0.1, 0.5, 0.9)]
) + " FROM ft GROUP BY 1"


@query("f5_outcome_summary", with_results(SUMMARY, TRIALS, RANKED))
def f5(spark, sf):
    return trials.outcome_summary(ranked(spark, sf))


MATRIX = ", ".join(f"avg(CASE WHEN pos = {p} THEN 1.0::DOUBLE ELSE 0 END) AS P{p}" for p in range(1, 21))


@query("f6_position_matrix", with_results("SELECT Driver, " + ", ".join(f"round(P{p}, 6) AS P{p}" for p in range(1, 21)) + " FROM mx", TRIALS, RANKED, f"mx AS (SELECT Driver, {MATRIX} FROM ft GROUP BY 1)"))
def f6(spark, sf):
    return rounded(trials.position_matrix(ranked(spark, sf)))


@query("f7_expected_order", with_results("SELECT Driver, round(" + " + ".join(f"P{p} * {p}" for p in range(1, 21)) + ", 6) AS Exp_Pos FROM mx", TRIALS, RANKED, f"mx AS (SELECT Driver, {MATRIX} FROM ft GROUP BY 1)"))
def f7(spark, sf):
    return rounded(trials.expected_order(trials.position_matrix(ranked(spark, sf))))


@query("f8_input_checks", with_results("SELECT count(*) AS rows FROM preds"))
def f8(spark, sf):
    """Valid input passes through; invalid input is covered by the tests."""
    rows = predictions(spark, sf).withColumnRenamed("pred", "Predicted_Race_Pos")
    trials.check_inputs(rows, 0.3)
    return rows.agg(F.count(F.lit(1)).alias("rows"))
