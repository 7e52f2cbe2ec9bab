"""E: input modes, grid, risk, bands, probabilities, baseline, batch scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankpanel.catalog.base import panel, predictions, query, rounded, with_results
from rankpanel.functions.columns import ERF_A, ERF_P
from rankpanel.operators import scoring
from rankpanel.plans import prediction as plan
from rankpanel.sources.tables import ROW_KEY, qualifying, races, results, schedule

ACTUAL_WHERE = "Race_Num % 3 <> 0"


def mode_inputs(spark, sf):
    """Qualifying is known for two of three rounds; predictions are last positions known before."""
    roster = results(spark, sf).select(*ROW_KEY, "Team")
    actual = qualifying(spark, sf).where(ACTUAL_WHERE).select(*ROW_KEY, F.col("Position").alias("Quali_Pos"))
    predicted = predictions(spark, sf).select(*ROW_KEY, F.col("p3").alias("Quali_Pos"))
    return roster, actual, predicted


@query(
    "e2_mode_auto",
    with_results(
        f"""SELECT Year, Race_Num, Driver, round(CASE WHEN {ACTUAL_WHERE} THEN r.Quali_Pos ELSE p3 END, 6) AS Quali_Pos,
            CASE WHEN {ACTUAL_WHERE} THEN 1 ELSE 0 END AS Post_Quali, CASE WHEN {ACTUAL_WHERE} THEN 'actual' ELSE 'predicted' END AS Quali_Source
            FROM results r JOIN preds USING (Year, Race_Num, Driver)"""
    ),
)
def e2_auto(spark, sf):
    return rounded(scoring.choose_qualifying(*_args(spark, sf, "auto")).drop("Team"))


def _args(spark, sf, mode):
    roster, actual, predicted = mode_inputs(spark, sf)
    return roster, mode, actual, predicted


@query("e2_mode_post_quali", with_results(f"SELECT Year, Race_Num, Driver, Quali_Pos, 1 AS Post_Quali, 'actual' AS Quali_Source FROM results WHERE {ACTUAL_WHERE}"))
def e2_post(spark, sf):
    return scoring.choose_qualifying(*_args(spark, sf, "post_quali")).drop("Team")


@query("e2_mode_pre_quali", with_results("SELECT Year, Race_Num, Driver, round(p3, 6) AS Quali_Pos, 0 AS Post_Quali, 'predicted' AS Quali_Source FROM preds"))
def e2_pre(spark, sf):
    return rounded(scoring.choose_qualifying(*_args(spark, sf, "pre_quali")).drop("Team"))


@query("e2_mode_pre_weekend", with_results("SELECT Year, Race_Num, Driver, CAST(NULL AS DOUBLE) AS Quali_Pos, 0 AS Post_Quali FROM results"))
def e2_weekend(spark, sf):
    return scoring.choose_qualifying(*_args(spark, sf, "pre_weekend")).drop("Team", "Quali_Source")


@query(
    "e3_grid_override",
    with_results("SELECT Year, Race_Num, Driver, CASE WHEN Race_Num % 2 = 0 THEN coalesce(Grid, Quali_Pos) ELSE Quali_Pos END AS Grid, 1 AS Parc_Ferme FROM results"),
)
def e3(spark, sf):
    """Grids are known for even rounds only."""
    rows = results(spark, sf).select(*ROW_KEY, "Quali_Pos", F.lit(1).alias("Post_Quali"))
    grid = races(spark, sf).where("Race_Num % 2 = 0").select(*ROW_KEY, "Grid")
    return scoring.override_grid(rows, grid).select(*ROW_KEY, "Grid", "Parc_Ferme")


@query(
    "e4_risk_adjusted",
    with_results(
        """SELECT Year, Race_Num, Driver, round((1 - p) * pred + p * CASE Circuit_Cluster WHEN 0 THEN 18.0::DOUBLE WHEN 1 THEN 22.0::DOUBLE ELSE 20.0::DOUBLE END, 6) AS expected
           FROM preds JOIN (SELECT Driver, avg(DNF) AS p FROM panel GROUP BY 1) USING (Driver)"""
    ),
)
def e4(spark, sf):
    rates = panel(spark, sf).groupBy("Driver").agg(F.avg("DNF").alias("p"))
    positions = panel(spark, sf).where("Circuit_Cluster < 2").groupBy("Circuit_Cluster").agg(F.lit(18.0).alias("_"))
    positions = positions.select("Circuit_Cluster", (18.0 + 4 * F.col("Circuit_Cluster")).alias("dnf_position"))
    out = scoring.risk_adjusted(predictions(spark, sf).join(rates, "Driver"), "pred", "p", "expected", positions)
    return rounded(out.select(*ROW_KEY, "expected"))


@query(
    "e5_formatted_results",
    with_results(
        """SELECT Year, Race_Num, row_number() OVER (PARTITION BY Year, Race_Num ORDER BY pred, Driver) AS Predicted_Pos, Driver, Team, pred AS Prediction_Score,
           'position_value' AS Score_Type FROM preds"""
    ),
)
def e5(spark, sf):
    return scoring.format_results(predictions(spark, sf), "pred", "position_value")


@query(
    "e6_bands",
    with_results(
        """SELECT Year, Race_Num, Driver, least(20.0::DOUBLE, greatest(1.0::DOUBLE, pred - 3.75)) AS Lower_Pos, least(20.0::DOUBLE, greatest(1.0::DOUBLE, pred + 3.75)) AS Upper_Pos FROM preds"""
    ),
)
def e6(spark, sf):
    return scoring.bands(predictions(spark, sf), "pred", std=2.5).select(*ROW_KEY, "Lower_Pos", "Upper_Pos")


@query(
    "e6_quantile_bands",
    with_results(
        """SELECT Year, Race_Num, Driver, CASE WHEN Quali_Pos IS NOT NULL THEN least(20.0::DOUBLE, greatest(1.0::DOUBLE, Quali_Pos - 4)) END AS Lower_Pos,
           CASE WHEN Quali_Pos IS NOT NULL THEN least(20.0::DOUBLE, greatest(1.0::DOUBLE, Quali_Pos + 4)) END AS Upper_Pos FROM panel"""
    ),
)
def e6_quantile(spark, sf):
    rows = panel(spark, sf).withColumns({"lo": F.col("Quali_Pos") - 4, "hi": F.col("Quali_Pos") + 4})
    return scoring.bands(rows, "Quali_Pos", low="lo", high="hi").select(*ROW_KEY, "Lower_Pos", "Upper_Pos")


def cdf_sql(z: str) -> str:
    """The same rational approximation as the column function."""
    x = f"(abs({z}) / sqrt(2.0::DOUBLE))"
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + {ERF_P}::DOUBLE * {x}))"
    poly = f"{ERF_A[4]}::DOUBLE"
    for a in reversed(ERF_A[:4]):
        poly = f"(({poly}) * {t} + ({a}::DOUBLE))"
    erf = f"(1.0::DOUBLE - {poly} * {t} * exp(-{x} * {x}))"
    return f"CASE WHEN {z} >= 0 THEN (1.0::DOUBLE + {erf}) / 2.0::DOUBLE ELSE (1.0::DOUBLE - {erf}) / 2.0::DOUBLE END"


@query(
    "e7_threshold_probabilities",
    with_results(
        f"""SELECT Year, Race_Num, Driver, round({cdf_sql('((3.5::DOUBLE - pred) / 2.5::DOUBLE)')}, 6) AS Prob_Podium,
            round({cdf_sql('((10.5::DOUBLE - pred) / 2.5::DOUBLE)')}, 6) AS Prob_Top10 FROM preds"""
    ),
)
def e7(spark, sf):
    return rounded(scoring.threshold_probabilities(predictions(spark, sf), "pred", 2.5).select(*ROW_KEY, "Prob_Podium", "Prob_Top10"))


BASE = """
hist AS (SELECT Driver, avg(Position) AS ap, avg(Quali_Pos) AS aq, avg(CASE WHEN Position = 1 THEN 1.0::DOUBLE ELSE 0 END) AS wr,
  avg(CASE WHEN Position <= 3 THEN 1.0::DOUBLE ELSE 0 END) AS pr, avg(DNF) AS dr FROM panel WHERE Year < 2001 AND Driver % 7 <> 0 GROUP BY 1),
joined AS (SELECT p.Year, p.Race_Num, p.Driver, p.Team, coalesce(ap, 10.5) AS ap, coalesce(aq, 10.5) AS aq,
  coalesce(wr, 0) + coalesce(pr, 0) - coalesce(dr, 0.2::DOUBLE) AS score FROM panel p LEFT JOIN hist USING (Driver) WHERE p.Year = 2001)
"""


def _baseline_sql(col):
    return with_results(
        f"SELECT Year, Race_Num, Driver, Team, row_number() OVER (PARTITION BY Year, Race_Num ORDER BY round({col}, 9), Driver) AS Predicted_Pos, round(score, 6) AS Prediction_Score FROM joined",
        BASE.strip(),
    )


def _baseline(spark, sf, session):
    """History before 2001, without every seventh driver, orders the events of 2001."""
    rows = panel(spark, sf)
    roster = rows.where("Year = 2001").select(*ROW_KEY, "Team")
    return rounded(scoring.baseline_order(roster, rows.where("Year < 2001 AND Driver % 7 <> 0"), session))


@query("e8_baseline_race", _baseline_sql("ap"))
def e8(spark, sf):
    return _baseline(spark, sf, "race")


@query("e8_baseline_qualifying", _baseline_sql("aq"))
def e8_quali(spark, sf):
    return _baseline(spark, sf, "qualifying")


@query("e1_qualifying_order")
def e1(spark, sf):
    """Score the last season's qualifying with a model fitted on the seasons before."""
    return plan.score_events(panel(spark, sf), schedule(spark, sf), "qualifying", train_before=2001)


@query("e9_batch_scoring")
def e9(spark, sf):
    """All rounds of the last season in one plan: features as of each event, model, ranks, bands."""
    return plan.score_events(panel(spark, sf), schedule(spark, sf), "race", train_before=2001)


@query("e1_order_properties", with_results("SELECT Year, Race_Num, count(*) AS entrants, 1 AS first, count(*) AS last, count(*) AS places FROM results WHERE Year >= 2001 GROUP BY 1, 2"))
def e1_properties(spark, sf):
    """The places of every event are a permutation of 1 to its number of entrants."""
    place = F.col("Predicted_Quali_Pos")
    return e1(spark, sf).groupBy("Year", "Race_Num").agg(
        F.count(F.lit(1)).alias("entrants"), F.min(place).alias("first"), F.max(place).alias("last"), F.count_distinct(place).alias("places")
    )


@query("e9_scoring_properties", with_results("SELECT Year, Race_Num, count(*) AS entrants, true AS in_band, true AS likely FROM results WHERE Year >= 2001 GROUP BY 1, 2"))
def e9_properties(spark, sf):
    """Every entrant is scored once, lies in its band (which ends at place 20), and the top ten is at least as likely as the podium."""
    place = F.least(F.col("Predicted_Race_Pos"), F.lit(20.0))
    in_band = (F.col("Lower_Pos") <= place) & (place <= F.col("Upper_Pos"))
    likely = (F.col("Prob_Podium") >= 0) & (F.col("Prob_Podium") <= F.col("Prob_Top10")) & (F.col("Prob_Top10") <= 1) & F.col("dnf_prob").between(0, 1)
    return e9(spark, sf).groupBy("Year", "Race_Num").agg(F.count_distinct("Driver").alias("entrants"), F.bool_and(in_band).alias("in_band"), F.bool_and(likely).alias("likely"))
