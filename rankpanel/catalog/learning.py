"""Out-of-fold tables, weights, blends, intervals, learned models."""

from __future__ import annotations

from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Window
from pyspark.sql import functions as F

from rankpanel.catalog.base import panel, predictions, query, rounded, with_results
from rankpanel.operators import ensemble, splits
from rankpanel.plans import prediction, training
from rankpanel.session import materialize
from rankpanel.sources.tables import ROW_KEY, stored

MODELS = ["pred", "p2", "p3"]


def matrix(spark, sf):
    """The race feature matrix, stored once, with its feature names."""
    table = stored(spark, sf, "matrix", lambda: prediction.feature_matrix(panel(spark, sf), "Position")[0])
    return table, [c for c in table.columns if c not in (*ROW_KEY, "Team", "DNF", "y")]


def time_folds(spark, sf, n=2):
    return materialize(splits.fold_events(panel(spark, sf), n, [2001], purge=1, embargo=1), "folds")


@query("d10_fold_regressors")
def d10(spark, sf):
    """Mean absolute error per fold and model."""
    table, features = matrix(spark, sf)
    oof = training.out_of_fold_predictions(table, features, time_folds(spark, sf), ranker=False)
    return oof.groupBy("model", "fold").agg(F.count(F.lit(1)).alias("rows"), F.avg(F.abs(F.col("y") - F.col("pred"))).alias("mae"))


@query("d11_pair_ranker")
def d11(spark, sf):
    """Mean per-event rank correlation of the order model on the held-out season."""
    table, features = matrix(spark, sf)
    medians = splits.train_medians(table.where("Year < 2001"), features)
    filled = materialize(splits.impute_from(table, medians, features), "filled")
    ranker = training.fit_pair_ranker(filled.where("Year < 2001"), features)
    ranks = splits.score_ranks(ranker.transform(filled.where("Year = 2001")), "prediction", "rank")
    return ensemble.event_rank_correlation(ranks, "y", "rank", ["Year", "Race_Num"])


@query("d12_parameter_search")
def d12(spark, sf):
    table, features = matrix(spark, sf)
    grid = [{"maxDepth": d, "numTrees": t} for d in (3, 5) for t in (5,)]

    def make(p):
        return RandomForestRegressor(featuresCol="features", labelCol="y", seed=42, **p)

    found = training.search_parameters(table, features, time_folds(spark, sf), make, grid, "spearman", max_trials=2, max_seconds=600)
    rows = [(i + 1, str(sorted(p.items())), loss) for i, (p, loss) in enumerate(found)]
    return spark.createDataFrame(rows, "place int, params string, loss double")


@query("d10_fold_properties", "SELECT model, 2 AS folds, 0 AS twice, true AS beats_mean FROM (VALUES ('forest'), ('gbt'), ('linear')) t(model)")
def d10_properties(spark, sf):
    """Every model covers both folds, a row once, and errs less than the mean position does."""
    table, features = matrix(spark, sf)
    oof = training.out_of_fold_predictions(table, features, time_folds(spark, sf), ranker=False)
    mean = F.avg("y").over(Window.partitionBy("model", "fold"))
    once = oof.withColumn("m", mean).groupBy("model", "fold", *ROW_KEY).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("y") - F.col("pred"))).alias("e"), F.max(F.abs(F.col("y") - F.col("m"))).alias("b")
    )
    return once.groupBy("model").agg(
        F.count_distinct("fold").cast("int").alias("folds"), F.sum((F.col("n") > 1).cast("int")).cast("int").alias("twice"), (F.avg("e") < F.avg("b")).alias("beats_mean")
    )


@query("d11_ranker_properties", with_results("SELECT Year, Race_Num, count(*) AS entrants, 1 AS first, count(*) AS last, count(*) AS places FROM results WHERE Year = 2001 GROUP BY 1, 2"))
def d11_properties(spark, sf):
    """The pair ranker's places of every held-out event are a permutation."""
    table, features = matrix(spark, sf)
    medians = splits.train_medians(table.where("Year < 2001"), features)
    filled = materialize(splits.impute_from(table, medians, features), "filled")
    ranker = training.fit_pair_ranker(filled.where("Year < 2001"), features)
    ranks = splits.score_ranks(ranker.transform(filled.where("Year = 2001")), "prediction", "rank")
    return ranks.groupBy("Year", "Race_Num").agg(
        F.count(F.lit(1)).alias("entrants"), F.min("rank").alias("first"), F.max("rank").alias("last"), F.count_distinct("rank").alias("places")
    )


@query("d12_search_properties", "SELECT * FROM (VALUES (1, true), (2, true)) t(place, in_order)")
def d12_properties(spark, sf):
    """Both settings are tried and come in the order of their loss."""
    before = F.lag("loss").over(Window.orderBy("place"))
    return d12(spark, sf).select("place", F.coalesce(before <= F.col("loss"), F.lit(True)).alias("in_order"))


FOLD_PREDS = f"""
lp AS (SELECT Year, Race_Num, Driver, y, unnest(['pred', 'p2', 'p3']) AS model, unnest([pred, p2, p3]) AS p FROM preds),
lf AS (SELECT * FROM lp WHERE NOT (model = 'p2' AND Driver % 11 = 0))
"""


def long_predictions(spark, sf):
    """(key, y, model, pred); one model lacks every eleventh driver."""
    rows = predictions(spark, sf).select(*ROW_KEY, "y", *MODELS)
    long = rows.unpivot([*ROW_KEY, "y"], MODELS, "model", "pred")
    return long.where(~((F.col("model") == "p2") & (F.col("Driver") % 11 == 0)))


@query("d13_out_of_fold_table", with_results("SELECT Year, Race_Num, Driver, pred, p2, round(p3, 6) AS p3 FROM preds WHERE Driver % 11 <> 0"))
def d13(spark, sf):
    return rounded(ensemble.out_of_fold(long_predictions(spark, sf), MODELS))


@query(
    "d14_best_parameters",
    with_results(
        """SELECT model, params, mae FROM (SELECT model, params, round(avg(e), 6) AS mae, row_number() OVER (PARTITION BY model ORDER BY round(avg(e), 9), params) AS r
           FROM (SELECT model, 'shift=' || s AS params, abs(y - p - s) AS e FROM lf, range(3) t(s)) GROUP BY 1, 2) WHERE r = 1""",
        FOLD_PREDS.strip(),
    ),
)
def d14(spark, sf):
    """Three parameter settings per model, each a shift of the prediction."""
    tried = long_predictions(spark, sf).select("model", "y", "pred", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("s"))
    err = F.col("y") - F.col("pred") - F.col("s")
    trials = tried.select("model", F.concat(F.lit("shift="), F.col("s").cast("string")).alias("params"), err.alias("err"))
    return rounded(ensemble.best_parameters(trials))


@query(
    "d15_median_iterations",
    with_results(
        "SELECT model, quantile_cont(CAST(it AS DOUBLE), 0.5) AS iterations FROM (SELECT model, Year, CAST(sum(y) AS BIGINT) % 50 AS it FROM lf GROUP BY 1, 2) WHERE it > 0 GROUP BY 1",
        FOLD_PREDS.strip(),
    ),
)
def d15(spark, sf):
    """Seasons as folds; the iteration count is a checksum of the season."""
    folds = long_predictions(spark, sf).groupBy("model", "Year").agg((F.sum("y").cast("long") % 50).alias("best_iteration"))
    return ensemble.median_iterations(folds)


def _mae_sql(segment: str, having: str) -> str:
    keys = f"{segment}, " if segment else ""
    part = f"PARTITION BY {segment} " if segment else ""
    return f"""SELECT {keys}n_rows, round(mae, 6) AS mae, a / 10.0::DOUBLE AS w_pred, b / 10.0::DOUBLE AS w_p2, c / 10.0::DOUBLE AS w_p3 FROM (
      SELECT {keys}a, b, c, count(*) AS n_rows, avg(abs(y - (pred * (a / 10.0::DOUBLE) + p2 * (b / 10.0::DOUBLE) + p3 * (c / 10.0::DOUBLE)))) AS mae,
        row_number() OVER ({part}ORDER BY round(avg(abs(y - (pred * (a / 10.0::DOUBLE) + p2 * (b / 10.0::DOUBLE) + p3 * (c / 10.0::DOUBLE)))), 9), a, b, c) AS r
      FROM preds, range(11) x(a), range(11) v(b), range(11) z(c) WHERE a + b + c = 10 GROUP BY {keys}a, b, c {having}) WHERE r = 1"""


@query("d16_mae_weights", with_results(_mae_sql("", "")))
def d16(spark, sf):
    return rounded(ensemble.mae_weights(predictions(spark, sf), "y", MODELS))


def _rank_weights_sql(score: str) -> str:
    return with_results(
        f"SELECT round(score, 6) AS score, w1 AS w_pred, w2 AS w_p2, w3 AS w_p3 FROM (SELECT i, w1, w2, w3, round(avg(s), 9) AS score FROM ({score}) GROUP BY ALL) ORDER BY round(score, 9) DESC, i LIMIT 1",
        """cand AS (SELECT 0 AS i, 1.0::DOUBLE / 3 AS w1, 1.0::DOUBLE / 3 AS w2, 1.0::DOUBLE / 3 AS w3
           UNION ALL SELECT row_number() OVER (ORDER BY a, b, c), a / 4.0::DOUBLE, b / 4.0::DOUBLE, c / 4.0::DOUBLE FROM range(5) x(a), range(5) v(b), range(5) z(c) WHERE a + b + c = 4)""",
        "bl AS (SELECT i, w1, w2, w3, Year, Race_Num, Driver, y, round(pred * w1 + p2 * w2 + p3 * w3, 9) AS blend FROM preds, cand)",
    )


SPEARMAN = """
SELECT i, w1, w2, w3, Year, Race_Num, CASE WHEN min(ry) < max(ry) AND min(rb) < max(rb) THEN corr(ry, rb) END AS s FROM (
  SELECT *, rank() OVER (PARTITION BY i, Year, Race_Num ORDER BY y) + (count(*) OVER (PARTITION BY i, Year, Race_Num, y) - 1) / 2.0::DOUBLE AS ry,
    rank() OVER (PARTITION BY i, Year, Race_Num ORDER BY blend) + (count(*) OVER (PARTITION BY i, Year, Race_Num, blend) - 1) / 2.0::DOUBLE AS rb FROM bl)
GROUP BY ALL HAVING count(*) >= 3"""
NDCG = """
SELECT i, w1, w2, w3, Year, Race_Num, sum(g / log2(rb + 1)) / sum(g / log2(ry + 1)) AS s FROM (
  SELECT *, pow(2.0::DOUBLE, 1.0::DOUBLE / greatest(1.0::DOUBLE, y)) - 1 AS g, row_number() OVER (PARTITION BY i, Year, Race_Num ORDER BY greatest(1.0::DOUBLE, blend), Driver) AS rb,
    row_number() OVER (PARTITION BY i, Year, Race_Num ORDER BY greatest(1.0::DOUBLE, y), Driver) AS ry FROM bl)
GROUP BY ALL HAVING count(*) >= 3"""


@query("d17_spearman_weights", _rank_weights_sql(SPEARMAN).replace("w1 AS w_pred, w2 AS w_p2, w3 AS w_p3", "round(w1, 6) AS w_pred, round(w2, 6) AS w_p2, round(w3, 6) AS w_p3"))
def d17(spark, sf):
    return rounded(ensemble.ranking_weights(predictions(spark, sf), "y", MODELS))


@query("d17_ndcg_weights", _rank_weights_sql(NDCG).replace("w1 AS w_pred, w2 AS w_p2, w3 AS w_p3", "round(w1, 6) AS w_pred, round(w2, 6) AS w_p2, round(w3, 6) AS w_p3"))
def d17_ndcg(spark, sf):
    return rounded(ensemble.ranking_weights(predictions(spark, sf), "y", MODELS, metric="ndcg"))


SEGMENTS = ["Circuit_Cluster", "Is_Sprint"]


@query("d18_segment_weights", with_results(_mae_sql("Circuit_Cluster, Is_Sprint", "HAVING count(*) >= 10")))
def d18(spark, sf):
    return rounded(ensemble.mae_weights(predictions(spark, sf), "y", MODELS, 10, SEGMENTS, 10))


BLEND = (
    f"sw AS ({_mae_sql('Circuit_Cluster, Is_Sprint', 'HAVING count(*) >= 10')})",
    """bd AS (SELECT p.*, CASE WHEN w_pred IS NOT NULL THEN pred * w_pred + p2 * w_p2 + p3 * w_p3 ELSE pred * 0.5 + p2 * 0.25 + p3 * 0.25 END AS blend
       FROM preds p LEFT JOIN (SELECT * FROM sw WHERE Circuit_Cluster <> 1) USING (Circuit_Cluster, Is_Sprint))""",
)


def blended(spark, sf):
    """Segment weights except for one segment, which falls back to the global weights."""
    rows = predictions(spark, sf)
    weights = ensemble.mae_weights(rows, "y", MODELS, 10, SEGMENTS, 10).where("Circuit_Cluster <> 1")
    return ensemble.blend(rows, MODELS, "blend", weights, SEGMENTS, [0.5, 0.25, 0.25])


@query("d19_weighted_blend", with_results("SELECT Year, Race_Num, Driver, round(blend, 6) AS blend FROM bd", *BLEND))
def d19(spark, sf):
    return rounded(blended(spark, sf).select(*ROW_KEY, "blend"))


@query("d20_residual_spread", with_results("SELECT round(stddev_pop(y - blend), 6) AS residual_std FROM bd", *BLEND))
def d20(spark, sf):
    return rounded(ensemble.residual_spread(blended(spark, sf), "y", "blend"))


@query(
    "d21_interval_offsets",
    with_results("SELECT Circuit_Cluster, round(quantile_cont(y - pred, 0.1), 6) AS lower_offset, round(quantile_cont(y - pred, 0.9), 6) AS upper_offset FROM preds GROUP BY 1"),
)
def d21(spark, sf):
    return rounded(ensemble.interval_offsets(predictions(spark, sf), "y", "pred", ["Circuit_Cluster"]))


@query("d22_dnf_probability")
def d22(spark, sf):
    """Mean calibrated probability and observed rate per season."""
    table, features = matrix(spark, sf)
    medians = splits.train_medians(table.where("Year < 2001"), features)
    filled = materialize(splits.impute_from(table, medians, features), "filled")
    model = training.fit_dnf_model(filled, features, [2001])
    return model.transform(filled).groupBy("Year").agg(F.avg("dnf_prob").alias("mean_prob"), F.avg("DNF").alias("observed"))


@query("d22_probability_properties", "SELECT true AS in_range, true AS near_rate")
def d22_properties(spark, sf):
    """Calibrated probabilities lie in 0 to 1, and their mean on the season they are calibrated on is the observed rate."""
    table, features = matrix(spark, sf)
    medians = splits.train_medians(table.where("Year < 2001"), features)
    filled = materialize(splits.impute_from(table, medians, features), "filled")
    scored = training.fit_dnf_model(filled, features, [2001]).transform(filled)
    gap = F.abs(F.avg(F.when(F.col("Year") == 2001, F.col("dnf_prob"))) - F.avg(F.when(F.col("Year") == 2001, F.col("DNF"))))
    return scored.agg(F.bool_and(F.col("dnf_prob").between(0, 1)).alias("in_range"), (gap < 0.02).alias("near_rate"))
