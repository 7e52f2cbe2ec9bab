"""G: metrics over the stored predictions; the qualifying position is the first model, the lagged form the second."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankpanel.catalog.base import predictions, query, rounded, with_results
from rankpanel.catalog.scoring import cdf_sql
from rankpanel.operators import metrics
from rankpanel.plans import evaluation as plan
from rankpanel.session import scratch_path
from rankpanel.sources import sinks
from rankpanel.sources.tables import stored


def per_event(spark, sf):
    return stored(spark, sf, "event_errors", lambda: metrics.event_errors(predictions(spark, sf)))


ERR = "err AS (SELECT *, abs(pred - y) AS e FROM preds)"


@query("g1_error_metrics", with_results("SELECT round(avg(e), 6) AS mae, round(avg(e * e), 6) AS mse, round(sqrt(avg(e * e)), 6) AS rmse, round(1 - sum(e * e) / sum((y - (SELECT avg(y) FROM preds)) ** 2), 6) AS r2 FROM err", ERR))
def g1(spark, sf):
    return rounded(metrics.error_metrics(predictions(spark, sf)))


def _share(cond):
    return f"round(avg(CASE WHEN {cond} THEN 1.0::DOUBLE ELSE 0 END), 6)"


@query("g2_tolerance_accuracy", with_results(f"SELECT {_share('e <= 3')} AS top3_accuracy, {_share('e <= 5')} AS top5_accuracy, {_share('e = 0')} AS exact_accuracy FROM err", ERR))
def g2(spark, sf):
    return rounded(metrics.tolerance_accuracy(predictions(spark, sf)))


@query(
    "g3_threshold_metrics",
    with_results(
        """SELECT round(tp3 / p3, 6) AS podium_precision, round(tp3 / t3, 6) AS podium_recall, round(2 * tp3 / p3 * tp3 / t3 / (tp3 / p3 + tp3 / t3), 6) AS podium_f1,
           round(tp10 / p10, 6) AS points_precision, round(tp10 / t10, 6) AS points_recall FROM c""",
        """c AS (SELECT count(*) FILTER (WHERE y <= 3 AND pred <= 3)::DOUBLE AS tp3, count(*) FILTER (WHERE pred <= 3)::DOUBLE AS p3, count(*) FILTER (WHERE y <= 3)::DOUBLE AS t3,
           count(*) FILTER (WHERE y <= 10 AND pred <= 10)::DOUBLE AS tp10, count(*) FILTER (WHERE pred <= 10)::DOUBLE AS p10, count(*) FILTER (WHERE y <= 10)::DOUBLE AS t10 FROM preds)""",
    ),
)
def g3(spark, sf):
    return rounded(metrics.threshold_metrics(predictions(spark, sf)))


@query("g4_weighted_mae", with_results("SELECT round(sum(e / y) / sum(1 / y), 6) AS weighted_mae FROM err", ERR))
def g4(spark, sf):
    """Front places weigh more."""
    return rounded(metrics.weighted_mae(predictions(spark, sf).withColumn("w", 1.0 / F.col("y")), weight="w"))


def _avg_rank(col, part=""):
    p = f"PARTITION BY {part} " if part else ""
    both = f"PARTITION BY {part + ', ' if part else ''}{col}"
    return f"(rank() OVER ({p}ORDER BY {col}) + (count(*) OVER ({both}) - 1) / 2.0::DOUBLE)"


@query("g5_spearman", with_results(f"SELECT round(corr(ry, rp), 6) AS rank_correlation FROM (SELECT {_avg_rank('y')} AS ry, {_avg_rank('pred')} AS rp FROM preds)"))
def g5(spark, sf):
    return rounded(metrics.spearman(predictions(spark, sf)))


EVENTS = f"""
er AS (SELECT *, {_avg_rank('y', 'Year, Race_Num')} AS ry, {_avg_rank('pred', 'Year, Race_Num')} AS rp FROM preds),
ev AS (SELECT Year, Race_Num, count(*) AS event_size, avg(abs(pred - y)) AS event_mae,
  CASE WHEN min(ry) < max(ry) AND min(rp) < max(rp) THEN corr(ry, rp) END AS event_spearman FROM er GROUP BY 1, 2 HAVING count(*) >= 3)
"""


@query("g6_event_errors", with_results("SELECT Year, Race_Num, event_size, round(event_mae, 6) AS event_mae, round(event_spearman, 6) AS event_spearman FROM ev", EVENTS.strip()))
def g6(spark, sf):
    return rounded(metrics.event_errors(predictions(spark, sf)))


NDCG = """
nr AS (SELECT *, row_number() OVER (PARTITION BY Year, Race_Num ORDER BY greatest(1.0::DOUBLE, pred), Driver) AS rp,
  row_number() OVER (PARTITION BY Year, Race_Num ORDER BY greatest(1.0::DOUBLE, y), Driver) AS rt, pow(2.0::DOUBLE, 1.0::DOUBLE / greatest(1.0::DOUBLE, y)) - 1 AS gain FROM preds),
nd AS (SELECT Year, Race_Num, count(*) AS event_size, sum(gain / log2(rp + 1)) / sum(gain / log2(rt + 1)) AS event_ndcg FROM nr GROUP BY 1, 2 HAVING count(*) >= 3)
"""


@query("g7_event_ndcg", with_results("SELECT Year, Race_Num, event_size, round(event_ndcg, 6) AS event_ndcg FROM nd", NDCG.strip()))
def g7(spark, sf):
    return rounded(metrics.event_ndcg(predictions(spark, sf)))


TOPK = """
kr AS (SELECT *, row_number() OVER (PARTITION BY Year, Race_Num ORDER BY pred, Driver) AS rp, row_number() OVER (PARTITION BY Year, Race_Num ORDER BY y, Driver) AS rt,
  count(*) OVER (PARTITION BY Year, Race_Num) AS n FROM preds),
kh AS (SELECT Year, Race_Num, k, n, rp, CASE WHEN rt <= k THEN 1.0::DOUBLE ELSE 0 END AS hit FROM kr, (VALUES (3), (5), (10)) t(k) WHERE rp <= k AND n >= 3),
kc AS (SELECT *, sum(hit) OVER (PARTITION BY Year, Race_Num, k ORDER BY rp ROWS UNBOUNDED PRECEDING) AS hits FROM kh),
tk AS (SELECT Year, Race_Num, k, max(n) AS event_size, sum(hit / log2(rp + 1)) / sum(1 / log2(rp + 1)) AS ndcg_at_k, sum(hit * hits / rp) / least(k, max(n)) AS map_at_k FROM kc GROUP BY 1, 2, 3)
"""


@query("g8_top_k_metrics", with_results("SELECT Year, Race_Num, k, event_size, round(ndcg_at_k, 6) AS ndcg_at_k, round(map_at_k, 6) AS map_at_k FROM tk", TOPK.strip()))
def g8(spark, sf):
    return rounded(metrics.event_top_k(predictions(spark, sf)))


@query("g9_macro_means", with_results("SELECT round(avg(event_mae), 6) AS event_mae, round(avg(event_spearman), 6) AS event_spearman FROM ev", EVENTS.strip()))
def g9(spark, sf):
    return rounded(metrics.macro_mean(per_event(spark, sf), ["event_mae", "event_spearman"]))


@query(
    "g9_all_macro_means",
    with_results(
        """SELECT (SELECT round(avg(event_mae), 6) FROM ev) AS event_mae, (SELECT round(avg(event_spearman), 6) FROM ev) AS event_spearman, (SELECT round(avg(event_ndcg), 6) FROM nd) AS event_ndcg, """
        + ", ".join(f"(SELECT round(avg({m}_at_k), 6) FROM tk WHERE k = {k}) AS {m}_at_{k}" for m in ("ndcg", "map") for k in (3, 5, 10)),
        EVENTS.strip(),
        NDCG.strip(),
        TOPK.strip(),
    ),
)
def g9_all(spark, sf):
    """Every per-event metric, averaged over the events."""
    rows = predictions(spark, sf)
    at_k = metrics.event_top_k(rows).groupBy("Year", "Race_Num").agg(
        *[F.max(F.when(F.col("k") == k, F.col(f"{m}_at_k"))).alias(f"{m}_at_{k}") for m in ("ndcg", "map") for k in (3, 5, 10)]
    )
    event = ["Year", "Race_Num"]
    joined = per_event(spark, sf).join(metrics.event_ndcg(rows).drop("event_size"), event, "full").join(at_k, event, "full")
    return rounded(metrics.macro_mean(joined, [c for c in joined.columns if c not in (*event, "event_size")]))


CURVE = f"""
sg AS (SELECT stddev_pop(pred - y) AS s FROM preds),
pb AS (SELECT k, round({cdf_sql('((k + 0.5::DOUBLE - pred) / greatest(s, 1e-6::DOUBLE))')}, 9) AS p, CASE WHEN y <= k THEN 1.0::DOUBLE ELSE 0 END AS hit FROM preds, sg, (VALUES (3), (5), (10)) t(k)),
ct AS (SELECT k, {', '.join(f'quantile_cont(p, {i / 10}) AS q{i}' for i in range(1, 10))} FROM pb GROUP BY 1),
cv AS (SELECT k, CAST({' + '.join(f'(q{i} < p)::INT' for i in range(1, 10))} AS INTEGER) AS bin, count(*) AS n_rows, avg(p) AS mean_pred, avg(hit) AS frac_pos FROM pb JOIN ct USING (k) GROUP BY 1, 2)
"""


@query("g10_reliability_curve", with_results("SELECT k, bin, n_rows, round(mean_pred, 6) AS mean_pred, round(frac_pos, 6) AS frac_pos FROM cv", CURVE.strip()))
def g10(spark, sf):
    return rounded(metrics.reliability_curve(predictions(spark, sf)))


@query("g10_calibration_error", with_results("SELECT k, round(sum(n_rows * abs(frac_pos - mean_pred)) / sum(n_rows), 6) AS ece FROM cv GROUP BY 1", CURVE.strip()))
def g10_ece(spark, sf):
    return rounded(metrics.calibration_error(metrics.reliability_curve(predictions(spark, sf))))


DRIFT = """
dr AS (SELECT *, CASE WHEN count(event_mae) OVER w >= 3 THEN avg(event_mae) OVER w END AS mae_roll,
  CASE WHEN count(event_spearman) OVER w >= 3 THEN avg(event_spearman) OVER w END AS spearman_roll
  FROM ev WINDOW w AS (ORDER BY Year, Race_Num ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
ds AS (SELECT arg_max(mae_roll, Year * 100 + Race_Num) - avg(event_mae) AS dm, avg(event_spearman) - arg_max(spearman_roll, Year * 100 + Race_Num) AS dsp FROM dr)
"""


@query("g11_drift_table", with_results("SELECT Year, Race_Num, event_size, round(event_mae, 6) AS event_mae, round(event_spearman, 6) AS event_spearman, round(mae_roll, 6) AS mae_roll, round(spearman_roll, 6) AS spearman_roll FROM dr", EVENTS.strip(), DRIFT.strip()))
def g11(spark, sf):
    return rounded(metrics.drift_table(per_event(spark, sf)))


@query(
    "g11_drift_summary",
    with_results(
        """SELECT round(coalesce(dm, 0), 6) AS mae_recent_minus_hist, round(coalesce(dsp, 0), 6) AS spearman_hist_minus_recent,
           CASE WHEN abs(dm) >= 0.5 THEN 1.0::DOUBLE ELSE 0 END AS alert_mae, CASE WHEN abs(dsp) >= 0.15 THEN 1.0::DOUBLE ELSE 0 END AS alert_spearman FROM ds""",
        EVENTS.strip(),
        DRIFT.strip(),
    ),
)
def g11_summary(spark, sf):
    return rounded(metrics.drift_summary(metrics.drift_table(per_event(spark, sf))))


COMPARE = f"cmp AS (SELECT *, r2 - r1 AS Rank_Change FROM (SELECT *, {_avg_rank('pred', 'Year, Race_Num')} AS r1, {_avg_rank('p3r', 'Year, Race_Num')} AS r2 FROM (SELECT *, round(p3, 9) AS p3r FROM preds)))"


def comparison(spark, sf):
    first = predictions(spark, sf)
    second = first.select("Year", "Race_Num", "Driver", F.round("p3", 9).alias("pred"))
    return stored(spark, sf, "comparison", lambda: metrics.compare_predictions(first, second))


@query("g12_compare_predictions", with_results("SELECT Year, Race_Num, Driver, Team, pred AS First_Pos, round(p3r, 6) AS Second_Pos, r1 AS First_Rank, r2 AS Second_Rank, Rank_Change FROM cmp", COMPARE))
def g12(spark, sf):
    first = predictions(spark, sf)
    second = first.select("Year", "Race_Num", "Driver", F.round("p3", 9).alias("pred"))
    return rounded(metrics.compare_predictions(first, second))


@query("g13_metrics_by_year", with_results(f"SELECT Year, round(avg(e), 6) AS mae, {_share('e <= 3')} AS top3_accuracy, count(*) AS sample_count FROM err GROUP BY 1", ERR))
def g13(spark, sf):
    return rounded(metrics.metrics_by_year(predictions(spark, sf)))


@query("g14_metrics_by_driver", with_results("SELECT Driver, round(avg(e), 6) AS mae, round(avg(pred - y), 6) AS bias, count(*) AS sample_count FROM err GROUP BY 1 HAVING count(*) > 5", ERR))
def g14(spark, sf):
    return rounded(metrics.metrics_by_driver(predictions(spark, sf)))


@query("g15_metrics_by_circuit", with_results("SELECT Circuit, round(avg(e), 6) AS mae, round(stddev_pop(e), 6) AS std_error, count(*) AS sample_count FROM err GROUP BY 1 HAVING count(*) > 3", ERR))
def g15(spark, sf):
    return rounded(metrics.metrics_by_circuit(predictions(spark, sf)))


G16 = """round(avg(e), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(d), 6) AS bias, round(stddev_pop(d), 6) AS std_error,
    round(avg(CASE WHEN e <= 3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS top3_accuracy, round(avg(CASE WHEN e <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS top5_accuracy,
    round(avg(CASE WHEN (Position <= 3) = (p <= 3) THEN 1.0::DOUBLE ELSE 0 END), 6) AS podium_accuracy, round(sum(e / Position) / sum(1 / Position), 6) AS weighted_mae, count(*) AS sample_count"""


@query(
    "g16_historical_scoring",
    with_results(
        f"""SELECT 'all' AS segment, 'all' AS value, {G16} FROM h
            UNION ALL SELECT 'Year', CAST(Year AS VARCHAR), {G16} FROM h GROUP BY 2
            UNION ALL SELECT 'Driver', CAST(Driver AS VARCHAR), {G16} FROM h GROUP BY 2 HAVING count(*) > 5
            UNION ALL SELECT 'Circuit', Circuit, {G16} FROM h GROUP BY 2 HAVING count(*) > 3""",
        "h AS (SELECT *, p - Position AS d, abs(p - Position) AS e FROM (SELECT *, 0.5::DOUBLE * coalesce(Quali_Pos, 0) + 0.5::DOUBLE * coalesce(Grid, 0) + 2.0::DOUBLE AS p FROM panel))",
    ),
)
def g16(spark, sf):
    """A linear score over two features with nulls and one that does not exist."""
    from rankpanel.catalog.base import panel

    def score(df):
        return df.withColumn("pred", 0.5 * F.col("Quali_Pos") + 0.5 * F.col("Grid") + F.col("Absent") + 2.0)

    return rounded(plan.historical_scoring(panel(spark, sf), ["Quali_Pos", "Grid", "Absent"], "Position", score))


@query("g17_movers_summary", with_results("SELECT count(*) FILTER (WHERE abs(Rank_Change) >= 2) AS significant_changes, round(avg(abs(Rank_Change)), 6) AS avg_change, max(abs(Rank_Change)) AS max_change FROM cmp", COMPARE))
def g17(spark, sf):
    return rounded(metrics.movers_summary(comparison(spark, sf)))


@query(
    "g17_top_movers",
    with_results(
        """(SELECT 'gainer' AS direction, Year, Race_Num, Driver, Rank_Change FROM cmp WHERE Rank_Change > 0 ORDER BY Rank_Change DESC, Year, Race_Num, Driver LIMIT 3)
           UNION ALL (SELECT 'loser', Year, Race_Num, Driver, Rank_Change FROM cmp WHERE Rank_Change < 0 ORDER BY Rank_Change, Year, Race_Num, Driver LIMIT 3)""",
        COMPARE,
    ),
)
def g17_top(spark, sf):
    return rounded(metrics.top_movers(comparison(spark, sf)))


G18 = ["mae", "mse", "rmse", "r2", "top3_accuracy", "top5_accuracy", "exact_accuracy", "podium_precision", "podium_recall", "points_precision", "points_recall"]


def _g18_sql(model: str, p: str) -> str:
    def share(k: int, of: str) -> str:
        return f"count(*) FILTER (WHERE y <= {k} AND {p} <= {k})::DOUBLE / count(*) FILTER (WHERE {of} <= {k})"

    e = f"abs({p} - y)"
    cells = [f"avg({e})", f"avg({e} * {e})", f"sqrt(avg({e} * {e}))", f"1 - sum({e} * {e}) / sum((y - (SELECT avg(y) FROM preds)) ** 2)"]
    cells += [f"avg(CASE WHEN {e} <= {k} THEN 1.0::DOUBLE ELSE 0 END)" for k in (3, 5, 0)]
    cells += [share(k, of) for k in (3, 10) for of in (p, "y")]
    return f"SELECT '{model}' AS model, " + ", ".join(f"{c} AS {n}" for c, n in zip(cells, G18)) + " FROM preds"


@query(
    "g18_metrics_long",
    with_results(f"SELECT model, metric, round(value, 6) AS value FROM ({_g18_sql('quali', 'pred')} UNION ALL {_g18_sql('grid', 'p2')}) UNPIVOT (value FOR metric IN ({', '.join(G18)}))"),
)
def g18(spark, sf):
    rows = predictions(spark, sf)
    long = None
    for model, col in (("quali", "pred"), ("grid", "p2")):
        for part in (metrics.error_metrics(rows, pred=col), metrics.tolerance_accuracy(rows, pred=col), metrics.threshold_metrics(rows, pred=col).drop("podium_f1")):
            one = metrics.metrics_long(part, model)
            long = one if long is None else long.unionByName(one)
    return rounded(long)


@query(
    "a15_evaluation_tables",
    with_results(
        """SELECT 'by_year' AS name, count(DISTINCT Year) AS rows FROM preds UNION ALL SELECT 'comparison', count(*) FROM cmp UNION ALL SELECT 'per_event', count(*) FROM ev
           UNION ALL SELECT 'reliability', count(*) FROM cv UNION ALL SELECT 'drift', count(*) FROM dr""",
        COMPARE,
        EVENTS.strip(),
        CURVE.strip(),
        DRIFT.strip(),
    ),
)
def a15_tables(spark, sf):
    """All five tables of an evaluation, written and read back."""
    rows = predictions(spark, sf)
    tables = {
        "by_year": metrics.metrics_by_year(rows),
        "comparison": comparison(spark, sf),
        "per_event": per_event(spark, sf),
        "reliability": metrics.reliability_curve(rows),
        "drift": metrics.drift_table(per_event(spark, sf)),
    }
    path = scratch_path(spark, "evaluation")
    sinks.write_evaluation(path, tables)
    out = None
    for name in tables:
        one = spark.read.parquet(f"{path}/{name}").agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows")).select("name", "rows")
        out = one if out is None else out.unionByName(one)
    return out
