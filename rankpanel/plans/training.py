"""Models on ``pyspark.ml``: folds, out-of-fold predictions, search, rankers, calibration.

The loops below run over models, folds and parameters, never over rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankpanel.operators import ensemble, splits
from rankpanel.operators.ordering import average_ranks, group_sizes, row_numbers
from rankpanel.session import materialize

EVENT = ["Year", "Race_Num"]
KEY = ["Year", "Race_Num", "Driver"]


def vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


def default_regressors(seed: int = 42) -> dict[str, Estimator]:
    common = {"featuresCol": "features", "labelCol": "y", "seed": seed}
    return {
        "gbt": GBTRegressor(maxIter=10, maxDepth=4, stepSize=0.2, **common),
        "forest": RandomForestRegressor(numTrees=15, maxDepth=6, **common),
        "linear": LinearRegression(featuresCol="features", labelCol="y", regParam=0.1),
    }


@dataclass(frozen=True)
class PairRanker:
    """Linear order model: a higher score finishes earlier."""

    features: tuple[str, ...]
    weights: tuple[float, ...]

    def score(self) -> Column:
        total = F.lit(0.0)
        for f, w in zip(self.features, self.weights, strict=True):
            total = total + F.col(f) * F.lit(w)
        return total

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return df.withColumn(out, self.score())


def fit_pair_ranker(train: DataFrame, features: Sequence[str], y: str = "y", reg: float = 0.01) -> PairRanker:
    """Pairwise order model from neighbouring finishers.

    Each entrant is paired with the next one in the event by an equi-join on
    (event, place), so pairs grow with rows, not with their square; the order
    of all others follows from the chain. Both directions are used.
    """
    placed = row_numbers(train.select(*KEY, y, *features), EVENT, [F.col(y), F.col("Driver")], "_place")
    ahead = placed.select(*EVENT, "_place", *[F.col(f).alias(f"_a_{f}") for f in features])
    behind = placed.select(*EVENT, (F.col("_place") - 1).alias("_place"), *[F.col(f).alias(f"_b_{f}") for f in features])
    diffs = ahead.join(behind, [*EVENT, "_place"]).select(*[(F.col(f"_a_{f}") - F.col(f"_b_{f}")).alias(f) for f in features])
    both = diffs.withColumn("label", F.lit(1.0)).unionByName(
        diffs.select(*[(-F.col(f)).alias(f) for f in features]).withColumn("label", F.lit(0.0))
    )
    pairs = vectors(materialize(both, "pairs"), features)
    model = LogisticRegression(featuresCol="features", labelCol="label", fitIntercept=False, regParam=reg).fit(pairs)
    return PairRanker(tuple(features), tuple(float(w) for w in model.coefficients))


def fold_frames(matrix: DataFrame, folds: DataFrame, features: Sequence[str]) -> Iterable[tuple[int, DataFrame, DataFrame]]:
    """(fold, train, val), imputed with the fold's own training medians."""
    # folds are few: the list of fold numbers is what is collected
    for row in folds.select("fold").distinct().orderBy("fold").collect():
        part = matrix.join(folds.where(F.col("fold") == row["fold"]), EVENT)
        train, val = part.where("role = 'train'"), part.where("role = 'val'")
        medians = splits.train_medians(train, features)
        yield row["fold"], materialize(splits.impute_from(train, medians, features), "train"), materialize(
            splits.impute_from(val, medians, features), "val"
        )


def out_of_fold_predictions(
    matrix: DataFrame, features: Sequence[str], folds: DataFrame, estimators: dict[str, Estimator] | None = None, ranker: bool = True
) -> DataFrame:
    """(event, Driver, fold, model, y, pred) for every validation row and model; ranks for the pair ranker."""
    estimators = default_regressors() if estimators is None else estimators
    out = None
    for fold, train, val in fold_frames(matrix, folds, features):
        parts = []
        train_v, val_v = vectors(train, features), vectors(val, features)
        for name, est in estimators.items():
            parts.append(est.fit(train_v).transform(val_v).select(*KEY, "y", F.lit(name).alias("model"), F.col("prediction").alias("pred")))
        if ranker:
            scored = fit_pair_ranker(train, features).transform(val)
            ranks = splits.score_ranks(scored, "prediction", "pred")
            parts.append(ranks.select(*KEY, "y", F.lit("pair").alias("model"), F.col("pred").cast("double").alias("pred")))
        for p in parts:
            p = p.withColumn("fold", F.lit(fold))
            out = p if out is None else out.unionByName(p)
    return materialize(out, "oof")


def even_parts(df: DataFrame, label: str, rows: int = 200_000) -> DataFrame:
    """Written in files of about equal numbers of rows, one per core at least, so that no task of a fit waits for another."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return materialize(df.repartition(max(cores, -(-df.count() // rows)), *KEY), label)


#: Bytes of the objects around a row that a fit of trees keeps, and the share of the storage memory that fits may fill.
ROW_OBJECTS, FIT_SHARE = 130, 0.5


def fits_at_once(spark: SparkSession, rows: int, features: int, trees: int, most: int = 4) -> int:
    """How many forests on ``rows`` may grow side by side: each keeps its binned rows and their draws in memory for all of its levels.

    Beyond the executors' memory every level of every fit would read them from disk.
    """
    status = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().values().iterator()
    room = []
    while status.hasNext():
        room.append(status.next()._1())
    if len(room) > 1:  # the driver is among them and keeps no rows
        room.remove(min(room))
    return max(1, min(most, int(FIT_SHARE * sum(room) / max(1, rows * (ROW_OBJECTS + 4 * (features + trees))))))


@dataclass(frozen=True)
class RankedRows:
    """Validation rows with the average ranks of ``y`` in their events, and the sizes that choose the plan of ranks."""

    rows: DataFrame  # key, y, _rank, features
    sizes: tuple[int, int]

    def loss(self, model: Model) -> float:
        """``validation_loss`` of a model by Spearman; only its predictions are ranked."""
        return validation_loss(model.transform(self.rows), "spearman", self.sizes, "_rank")


def ranked_rows(df: DataFrame, label: str) -> RankedRows:
    sizes = group_sizes(df, EVENT)
    return RankedRows(materialize(average_ranks(df, "y", EVENT, "_rank", sizes=sizes), label), sizes)


def validation_loss(scored: DataFrame, metric: str, sizes: tuple[int, int] | None = None, target_rank: str | None = None) -> float:
    """MAE, or 1 - (mean per-event Spearman + 1) / 2."""
    if metric == "mae":
        return scored.agg(F.avg(F.abs(F.col("y") - F.col("prediction"))).alias("v")).first()["v"]
    corr = ensemble.event_rank_correlation(scored, "y", "prediction", EVENT, sizes, target_rank=target_rank)
    rho = corr.agg(F.avg("spearman").alias("v")).first()["v"]
    return 1.0 - ((rho if rho is not None else -1.0) + 1.0) / 2.0


def search_parameters(
    matrix: DataFrame,
    features: Sequence[str],
    folds: DataFrame,
    make: Callable[[dict], Estimator],
    grid: Sequence[dict],
    metric: str = "spearman",
    max_trials: int | None = None,
    max_seconds: float | None = None,
) -> list[tuple[dict, float]]:
    """Mean validation loss per parameter set, best first; stops at the trial or time budget."""
    prepared = [(vectors(t, features), vectors(v, features)) for _, t, v in fold_frames(matrix, folds, features)]
    deadline = time.monotonic() + max_seconds if max_seconds else None
    done = []
    for params in grid[: max_trials or len(grid)]:
        if done and deadline and time.monotonic() > deadline:
            break
        losses = [validation_loss(make(params).fit(t).transform(v), metric) for t, v in prepared]
        done.append((params, sum(losses) / len(losses)))
    return sorted(done, key=lambda x: x[1])


@dataclass(frozen=True)
class DnfModel:
    """Retirement classifier with a calibrated probability."""

    classifier: Model
    calibrator: Model
    features: tuple[str, ...]
    method: str

    def transform(self, df: DataFrame, out: str = "dnf_prob") -> DataFrame:
        raw = _class_score(self.classifier, vectors(df, self.features))
        if self.method == "isotonic":
            scored = self.calibrator.transform(raw).withColumn(out, F.col("_calibrated"))
        else:
            one = VectorAssembler(inputCols=["_raw"], outputCol="_v").transform(raw)
            scored = self.calibrator.transform(one).withColumn(out, vector_to_array("_cal_prob")[1])
        return scored.withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(out)))).select(*df.columns, out)


def _class_score(classifier: Model, df: DataFrame) -> DataFrame:
    return classifier.transform(df).withColumn("_raw", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")


def fit_dnf_model(df: DataFrame, features: Sequence[str], holdout_years: Sequence[int], method: str = "isotonic") -> DnfModel:
    """Classifier on the training split, calibration on the held-out split."""
    labelled = splits.holdout_split(df.na.drop(subset=["DNF"]).withColumn("label", F.col("DNF").cast("double")), holdout_years)
    labelled = materialize(labelled.select(*KEY, "label", "split", *features), "dnf")
    classifier = LogisticRegression(featuresCol="features", labelCol="label", regParam=0.01).fit(
        vectors(labelled.where("split = 'train'"), features)
    )
    held = _class_score(classifier, vectors(labelled.where("split = 'test'"), features))
    if method == "isotonic":
        calibrator = IsotonicRegression(featuresCol="_raw", labelCol="label", predictionCol="_calibrated").fit(held)
    else:
        method = "sigmoid"
        one = VectorAssembler(inputCols=["_raw"], outputCol="_v").transform(held)
        calibrator = LogisticRegression(
            featuresCol="_v", labelCol="label", probabilityCol="_cal_prob", rawPredictionCol="_cal_raw", predictionCol="_cal_label"
        ).fit(one)
    return DnfModel(classifier, calibrator, tuple(features), method)
