"""Evaluation metrics over (event, Driver, y, pred) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankpanel.functions.columns import prob_at_most
from rankpanel.operators.ensemble import correlation, event_dcg_ratio, event_rank_correlation
from rankpanel.operators.ordering import average_ranks, exact_quantiles, group_sizes, row_numbers
from rankpanel.operators.timeline import Frame, lagged_frames
from rankpanel.session import materialize

EVENT = ["Year", "Race_Num"]
KEY = ["Year", "Race_Num", "Driver"]
K_LIST = (3, 5, 10)


def _share(cond: Column) -> Column:
    return F.avg(F.when(cond, 1.0).otherwise(0.0))


def error_metrics(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """MAE, MSE, RMSE and R2; targets are centred on the stored mean before squaring."""
    e = F.col(pred) - F.col(y)
    centre = df.agg(F.avg(y)).scalar()
    d = F.col(y) - centre
    return df.agg(
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (1.0 - F.try_divide(F.sum(e * e), F.nullif(F.sum(d * d), F.lit(0.0)))).alias("r2"),
    )


def tolerance_accuracy(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    e = F.abs(F.col(pred) - F.col(y))
    return df.agg(_share(e <= 3).alias("top3_accuracy"), _share(e <= 5).alias("top5_accuracy"), _share(e == 0).alias("exact_accuracy"))


def threshold_metrics(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """Podium (3) and points (10) precision and recall; null when no row truly qualifies."""
    out = []
    for name, k in (("podium", 3), ("points", 10)):
        t, p = F.col(y) <= k, F.col(pred) <= k
        both = F.sum(F.when(t & p, 1.0).otherwise(0.0))
        true, guess = F.sum(F.when(t, 1.0).otherwise(0.0)), F.sum(F.when(p, 1.0).otherwise(0.0))
        precision = F.coalesce(F.try_divide(both, F.nullif(guess, F.lit(0.0))), F.lit(0.0))
        recall = F.try_divide(both, F.nullif(true, F.lit(0.0)))
        out += [F.when(true > 0, precision).alias(f"{name}_precision"), F.when(true > 0, recall).alias(f"{name}_recall")]
        if name == "podium":
            f1 = F.coalesce(F.try_divide(2 * precision * recall, F.nullif(precision + recall, F.lit(0.0))), F.lit(0.0))
            out.append(F.when(true > 0, f1).alias("podium_f1"))
    return df.agg(*out)


def weighted_mae(df: DataFrame, y: str = "y", pred: str = "pred", weight: str | None = None) -> DataFrame:
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return df.agg(F.try_divide(F.sum(w * F.abs(F.col(pred) - F.col(y))), F.sum(w)).alias("weighted_mae"))


def spearman(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """Global rank correlation; ranks come from value counts, not from one sorted task."""
    both = df.where(F.col(y).isNotNull() & F.col(pred).isNotNull())
    ranked = average_ranks(average_ranks(both, y, [], "_ry"), pred, [], "_rp")
    return ranked.agg(correlation("_ry", "_rp").alias("rank_correlation"))


def event_errors(df: DataFrame, y: str = "y", pred: str = "pred", min_rows: int = 3, sizes=None) -> DataFrame:
    """Per event: size, MAE and Spearman."""
    mae = df.groupBy(*EVENT).agg(F.avg(F.abs(F.col(pred) - F.col(y))).alias("event_mae"))
    corr = event_rank_correlation(df, y, pred, EVENT, sizes, min_rows)
    return corr.join(mae, EVENT).select(*EVENT, "event_size", "event_mae", F.col("spearman").alias("event_spearman"))


def event_ndcg(df: DataFrame, y: str = "y", pred: str = "pred", min_rows: int = 3, sizes=None) -> DataFrame:
    return event_dcg_ratio(df, y, pred, EVENT, sizes, min_rows).withColumnRenamed("ndcg", "event_ndcg")


def event_top_k(df: DataFrame, y: str = "y", pred: str = "pred", ks: Sequence[int] = K_LIST, min_rows: int = 3, sizes=None) -> DataFrame:
    """NDCG@k and MAP@k of the predicted against the true top k, per event.

    Only the first k predicted rows of an event reach the second stage.
    """
    sizes = sizes or group_sizes(df, EVENT)
    df = row_numbers(df, EVENT, [F.col(pred), F.col("Driver")], "_rp", sizes)
    df = row_numbers(df, EVENT, [F.col(y), F.col("Driver")], "_rt", sizes)
    n = df.groupBy(*EVENT).agg(F.count(F.lit(1)).alias("event_size")).where(F.col("event_size") >= min_rows)
    top = df.where(F.col("_rp") <= max(ks)).select(*EVENT, "_rp", "_rt")
    top = top.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where(F.col("_rp") <= F.col("k"))
    hit = F.when(F.col("_rt") <= F.col("k"), 1.0).otherwise(0.0)
    counted = lagged_frames(
        top.withColumn("_hit", hit), [*EVENT, "k"], [Frame("_prev", "sum", "_hit")], ["_rp"], (max(ks), max(ks))
    )
    discount = F.log2(F.col("_rp") + 1.0)
    ideal = F.sum(F.lit(1.0) / discount)
    precision = F.col("_hit") * (F.coalesce("_prev", F.lit(0.0)) + F.col("_hit")) / F.col("_rp")
    per = counted.groupBy(*EVENT, "k").agg(
        (F.sum(F.col("_hit") / discount) / ideal).alias("ndcg_at_k"), F.sum(precision).alias("_ap")
    )
    return per.join(n, EVENT).select(
        *EVENT, "k", "event_size", "ndcg_at_k", (F.col("_ap") / F.least(F.col("k"), F.col("event_size"))).alias("map_at_k")
    )


def macro_mean(per_event: DataFrame, columns: Sequence[str]) -> DataFrame:
    return per_event.agg(*[F.avg(c).alias(c) for c in columns])


def reliability_curve(
    df: DataFrame, sigma: float | None = None, ks: Sequence[int] = K_LIST, bins: int = 10, y: str = "y", pred: str = "pred"
) -> DataFrame:
    """Per k and probability bin: rows, mean predicted and observed share; bins are quantiles."""
    spread = F.lit(float(sigma)) if sigma and sigma > 0 else df.agg(F.stddev_pop(F.col(pred) - F.col(y))).scalar()
    probs = df.withColumn("_sigma", spread).select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(k).alias("k"),
                        F.round(prob_at_most(k, F.col(pred), F.col("_sigma")), 9).alias("p"),
                        F.when(F.col(y) <= k, 1.0).otherwise(0.0).alias("hit"),
                    )
                    for k in ks
                ]
            )
        ).alias("r")
    ).select("r.k", "r.p", "r.hit")
    cuts = exact_quantiles(probs, "p", {f"q{i}": i / bins for i in range(1, bins)}, ["k"])
    # one row per k: the list of k bounds the broadcast side
    marked = probs.join(F.broadcast(cuts), "k")
    bin_no = F.lit(0)
    for i in range(1, bins):
        bin_no = bin_no + F.when(F.col(f"q{i}") < F.col("p"), 1).otherwise(0)
    return (
        marked.groupBy("k", bin_no.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n_rows"), F.avg("p").alias("mean_pred"), F.avg("hit").alias("frac_pos"))
    )


def calibration_error(curve: DataFrame) -> DataFrame:
    """Expected calibration error per k, weighted by the curve's own bins."""
    gap = F.abs(F.col("frac_pos") - F.col("mean_pred"))
    return curve.groupBy("k").agg((F.sum(F.col("n_rows") * gap) / F.sum("n_rows")).alias("ece"))


def drift_table(per_event: DataFrame, window: int = 6) -> DataFrame:
    """Rolling mean of event MAE and Spearman over the last ``window`` events, this one included."""
    # one row per event; written once because the frame checks its size
    out = materialize(per_event, "events")
    names = {"event_mae": "mae_roll", "event_spearman": "spearman_roll"}
    frames = []
    for c in names:
        frames += [Frame(f"_s_{c}", "sum", c, window - 1), Frame(f"_n_{c}", "count", c, window - 1)]
    out = lagged_frames(out, [], frames, EVENT)
    least = max(2, window // 2)
    cols = []
    for c, name in names.items():
        n = F.coalesce(f"_n_{c}", F.lit(0)) + F.when(F.col(c).isNotNull(), 1).otherwise(0)
        s = F.coalesce(f"_s_{c}", F.lit(0.0)) + F.coalesce(c, F.lit(0.0))
        cols.append(F.when(n >= least, F.try_divide(s, n)).alias(name))
    return out.select(*per_event.columns, *cols)


# Alert limits.
def drift_summary(drift: DataFrame, mae_limit: float = 0.5, spearman_limit: float = 0.15) -> DataFrame:
    """Latest rolling values against the whole history, with alerts."""
    last = F.max_by(F.struct("mae_roll", "spearman_roll"), F.struct(*EVENT))
    one = drift.agg(last.alias("r"), F.avg("event_mae").alias("m"), F.avg("event_spearman").alias("s"))
    dm, ds = F.col("r.mae_roll") - F.col("m"), F.col("s") - F.col("r.spearman_roll")
    zero = F.lit(0.0)

    def alert(c: Column, limit: float) -> Column:
        return F.when(F.abs(c) >= limit, 1.0).otherwise(0.0)

    return one.select(
        F.coalesce(dm, zero).alias("mae_recent_minus_hist"),
        F.coalesce(ds, zero).alias("spearman_hist_minus_recent"),
        alert(dm, mae_limit).alias("alert_mae"),
        alert(ds, spearman_limit).alias("alert_spearman"),
    )


def compare_predictions(first: DataFrame, second: DataFrame, pos: str = "pred") -> DataFrame:
    """Entrants in both sets with their average ranks per event and the rank change."""
    both = first.select(*KEY, "Team", F.col(pos).alias("First_Pos")).join(second.select(*KEY, F.col(pos).alias("Second_Pos")), KEY)
    sizes = group_sizes(first, EVENT)
    ranked = average_ranks(both, "First_Pos", EVENT, "First_Rank", sizes=sizes)
    ranked = average_ranks(ranked, "Second_Pos", EVENT, "Second_Rank", sizes=sizes)
    return ranked.withColumn("Rank_Change", F.col("Second_Rank") - F.col("First_Rank"))


def metrics_by_year(df: DataFrame) -> DataFrame:
    e = F.abs(F.col("pred") - F.col("y"))
    return df.groupBy("Year").agg(F.avg(e).alias("mae"), _share(e <= 3).alias("top3_accuracy"), F.count(F.lit(1)).alias("sample_count"))


def metrics_by_driver(df: DataFrame, more_than: int = 5) -> DataFrame:
    e = F.col("pred") - F.col("y")
    out = df.groupBy("Driver").agg(F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), F.count(F.lit(1)).alias("sample_count"))
    return out.where(F.col("sample_count") > more_than)


def metrics_by_circuit(df: DataFrame, more_than: int = 3) -> DataFrame:
    e = F.abs(F.col("pred") - F.col("y"))
    out = df.groupBy("Circuit").agg(F.avg(e).alias("mae"), F.stddev_pop(e).alias("std_error"), F.count(F.lit(1)).alias("sample_count"))
    return out.where(F.col("sample_count") > more_than)


def movers_summary(comparison: DataFrame) -> DataFrame:
    c = F.abs(F.col("Rank_Change"))
    return comparison.agg(
        F.count(F.when(c >= 2, 1)).alias("significant_changes"), F.avg(c).alias("avg_change"), F.max(c).alias("max_change")
    )


def top_movers(comparison: DataFrame, n: int = 3) -> DataFrame:
    """The n largest gains and losses, each strictly away from zero."""
    change = F.col("Rank_Change")
    ties = [F.col(c) for c in KEY]
    up = comparison.where(change > 0).orderBy(change.desc(), *ties).limit(n).withColumn("direction", F.lit("gainer"))
    down = comparison.where(change < 0).orderBy(change.asc(), *ties).limit(n).withColumn("direction", F.lit("loser"))
    return up.unionByName(down).select("direction", *KEY, "Rank_Change")


def metrics_long(wide: DataFrame, model: str) -> DataFrame:
    """One row per (model, metric)."""
    cols = [F.col(c).cast("double").alias(c) for c in wide.columns]
    return wide.select(*cols).unpivot([], wide.columns, "metric", "value").select(F.lit(model).alias("model"), "metric", "value")
