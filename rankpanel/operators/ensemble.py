"""Out-of-fold tables, ensemble weights, blends and spreads."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankpanel.operators.ordering import average_ranks, exact_quantiles, group_sizes, row_numbers
from rankpanel.session import join_small, max_group_rows

EVENT = ["Year", "Race_Num"]


def simplex(models: int, parts: int) -> list[tuple[float, ...]]:
    """All weight vectors whose entries are multiples of ``1 / parts`` and sum to 1, made from the places of the bars between them."""
    total = parts + models - 1
    out = []
    for bars in itertools.combinations(range(total), models - 1):
        edges = (-1, *bars, total)
        out.append(tuple((b - a - 1) / parts for a, b in zip(edges, edges[1:])))
    return out


def _blend(models: Sequence[str], weights: Sequence[float]) -> str:
    """Weighted sum as SQL text: dozens of candidates parse faster than they build call by call."""
    return "(" + " + ".join(f"`{m}` * {float(w)!r}D" for m, w in zip(models, weights, strict=True)) + ")"


def _table(grid: Sequence[Sequence[float]]) -> Column:
    """The candidates as an array of arrays."""
    rows = ", ".join("array(" + ", ".join(f"{float(x)!r}D" for x in w) + ")" for w in grid)
    return F.expr(f"array({rows})")


def out_of_fold(predictions: DataFrame, models: Sequence[str], keys: Sequence[str] = ("Year", "Race_Num", "Driver")) -> DataFrame:
    """(key, model, pred) rows to one column per model; only rows every model covers."""
    wide = predictions.groupBy(*keys).agg(*[F.max(F.when(F.col("model") == m, F.col("pred"))).alias(m) for m in models])
    return wide.na.drop(subset=list(models))


def best_parameters(trials: DataFrame) -> DataFrame:
    """Per model: the parameters with the least mean absolute error, and that error."""
    mean = trials.groupBy("model", "params").agg(F.avg(F.abs(F.col("err"))).alias("mae"))
    best = mean.groupBy("model").agg(F.min(F.struct(F.round("mae", 9).alias("mae"), "params")).alias("b"))
    return best.select("model", F.col("b.params").alias("params"), F.col("b.mae").alias("mae"))


def median_iterations(folds: DataFrame) -> DataFrame:
    """Median of the positive best iterations per model."""
    return exact_quantiles(folds.where(F.col("best_iteration") > 0), "best_iteration", {"iterations": 0.5}, ["model"])


def mae_weights(
    oof: DataFrame, target: str, models: Sequence[str], parts: int = 10, segments: Sequence[str] = (), min_rows: int = 1
) -> DataFrame:
    """Weights on the simplex grid with the least mean absolute error, per segment if given.

    Every candidate is one aggregate of the same pass: no candidate rows are
    made. Ties go to the earlier candidate. Segments under ``min_rows`` are left out.
    """
    grid = simplex(len(models), parts)
    errors = [F.expr(f"avg(abs(`{target}` - {_blend(models, w)}))").alias(f"c{i}") for i, w in enumerate(grid)]
    scored = oof.groupBy(*segments).agg(F.count(F.lit(1)).alias("n_rows"), *errors).where(F.col("n_rows") >= min_rows)
    tried = ", ".join(f"struct(round(c{i}, 9) AS mae, {i} AS candidate)" for i in range(len(grid)))
    best, table = F.expr(f"array_min(array({tried}))"), _table(grid)
    picked = scored.select(*segments, "n_rows", best.alias("b"), table.alias("t"))
    weights = F.element_at("t", F.col("b.candidate") + 1)
    return picked.select(
        *segments, "n_rows", F.col("b.mae").alias("mae"), *[F.element_at(weights, i + 1).alias(f"w_{m}") for i, m in enumerate(models)]
    )


def correlation(a: str, b: str) -> Column:
    """Pearson correlation as an aggregate; null instead of an error without variance."""
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.try_divide(F.covar_pop(a, b), F.nullif(spread, F.lit(0.0)))


def event_rank_correlation(df: DataFrame, target: str, pred: str, keys: Sequence[str], sizes=None, min_rows: int = 3, target_rank: str | None = None) -> DataFrame:
    """Spearman correlation per group of at least ``min_rows`` rows; null without variance.

    ``target_rank`` names a column that holds the average ranks of ``target`` already.
    """
    sizes = sizes or group_sizes(df, keys)
    df = df.withColumn("_rt", F.col(target_rank)) if target_rank else average_ranks(df, target, keys, "_rt", sizes=sizes)
    df = average_ranks(df, pred, keys, "_rp", sizes=sizes)
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("event_size"), correlation("_rt", "_rp").alias("spearman"))
        .where(F.col("event_size") >= min_rows)
    )


def event_dcg_ratio(df: DataFrame, target: str, pred: str, keys: Sequence[str], sizes=None, min_rows: int = 3) -> DataFrame:
    """NDCG of the order by ``pred`` with relevance 1 / max(1, target), per group."""
    sizes = sizes or group_sizes(df, keys)
    df = row_numbers(df, keys, [F.greatest(F.lit(1.0), F.col(pred)), F.col("Driver")], "_rp", sizes)
    df = row_numbers(df, keys, [F.greatest(F.lit(1.0), F.col(target)), F.col("Driver")], "_rt", sizes)
    gain = F.pow(F.lit(2.0), F.lit(1.0) / F.greatest(F.lit(1.0), F.col(target))) - 1.0
    dcg = F.sum(gain / F.log2(F.col("_rp") + 1.0))
    ideal = F.sum(gain / F.log2(F.col("_rt") + 1.0))
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("event_size"), F.when(ideal > 0, dcg / ideal).otherwise(0.0).alias("ndcg"))
        .where(F.col("event_size") >= min_rows)
    )


def _tried_rows(oof: DataFrame, target: str, models: Sequence[str], metric: str, grid: Sequence[Sequence[float]], sizes: tuple[int, int]) -> DataFrame:
    """(candidate, event, metric) by rows times candidates."""
    blends = F.array(*[F.struct(F.lit(i).alias("candidate"), F.expr(_blend(models, w)).alias("blend")) for i, w in enumerate(grid)])
    tried = oof.select(*EVENT, "Driver", target, F.explode(blends).alias("c")).select(
        *EVENT, "Driver", target, "c.candidate", F.round("c.blend", 9).alias("blend")
    )
    score = event_rank_correlation if metric == "spearman" else event_dcg_ratio
    return score(tried, target, "blend", ["candidate", *EVENT], sizes)


def ranking_weights(
    oof: DataFrame, target: str, models: Sequence[str], parts: int = 4, metric: str = "spearman"
) -> DataFrame:
    """Weights with the best mean per-event Spearman or NDCG; candidates are the grid and the uniform vector.

    An event's rows are shuffled once, and the task that has them orders them by
    every candidate. Only events beyond ``maxGroupRows``, and tables with missing
    values, are multiplied by the fixed number of candidates, so that one shuffle
    ranks all of them.
    """
    uniform = tuple(1.0 / len(models) for _ in models)
    grid = [uniform, *[w for w in simplex(len(models), parts) if w != uniform]]
    column = "spearman" if metric == "spearman" else "ndcg"
    hole = F.lit(False)
    for c in ("Driver", target, *models):
        hole = hole | F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    events = oof.groupBy(*EVENT).agg(F.count(F.lit(1)).alias("_n"), F.count_if(hole).alias("_holes"))
    size = events.agg(F.max("_n").alias("most"), F.min("_n").alias("least"), F.sum("_n").alias("rows"), F.sum("_holes").alias("holes"), F.count(F.lit(1)).alias("events")).first()
    if size["events"] and not size["holes"] and size["most"] <= max_group_rows(oof.sparkSession):
        from rankpanel.operators import racing  # which builds on this module

        rows = oof if size["least"] >= 3 else join_small(oof, events.where("_n >= 3").select(*EVENT), EVENT, "events", "inner")
        per_event = racing.event_scores(rows, target, models, column, grid, range(len(grid)), size["events"])
    else:
        per_event = _tried_rows(oof, target, models, column, grid, (size["most"] or 0, (size["rows"] or 0) * len(grid)))
    means = per_event.groupBy("candidate").agg(F.round(F.avg(column), 9).alias("score"))
    best = means.agg(F.max(F.struct("score", (-F.col("candidate")).alias("neg"))).alias("b"))
    table = _table(grid)
    weights = F.element_at(table, 1 - F.col("b.neg"))
    return best.select(
        F.col("b.score").alias("score"), *[F.element_at(weights, i + 1).alias(f"w_{m}") for i, m in enumerate(models)]
    )


def blend(
    df: DataFrame,
    models: Sequence[str],
    out: str = "blend",
    segment_weights: DataFrame | None = None,
    segments: Sequence[str] = (),
    global_weights: Sequence[float] | None = None,
) -> DataFrame:
    """Weighted mean of the models: segment weights, else global, else equal; always renormalised."""
    base = list(global_weights) if global_weights is not None else [1.0 / len(models)] * len(models)
    w = [F.lit(float(x)) for x in base]
    wide = df
    if segment_weights is not None:
        side = segment_weights.select(*segments, *[F.col(f"w_{m}").alias(f"_w_{m}") for m in models])
        wide = join_small(df, side, list(segments), "segment-weights")
        w = [F.coalesce(F.col(f"_w_{m}"), x) for m, x in zip(models, w, strict=True)]
    total, norm = F.lit(0.0), F.lit(0.0)
    for m, x in zip(models, w, strict=True):
        total, norm = total + F.col(m) * x, norm + x
    value = F.try_divide(total, F.when(norm == 0, F.lit(1.0)).otherwise(norm))
    return wide.select(*df.columns, value.alias(out))


def residual_spread(oof: DataFrame, target: str, pred: str) -> DataFrame:
    """Population deviation of the residuals of covered rows."""
    covered = oof.where(F.col(pred).isNotNull() & F.col(target).isNotNull())
    return covered.agg(F.stddev_pop(F.col(target) - F.col(pred)).alias("residual_std"))


def interval_offsets(oof: DataFrame, target: str, pred: str, segments: Sequence[str] = (), low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Residual quantiles, to be added to a prediction as its bounds."""
    res = oof.withColumn("_res", F.col(target) - F.col(pred))
    return exact_quantiles(res, "_res", {"lower_offset": low, "upper_offset": high}, segments)
