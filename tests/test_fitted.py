"""Search, solvers, races, medians, boosting, stored models, intervals: against direct computations."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import functions as F

from rankpanel.operators import convex_weights, ensemble, racing
from rankpanel.operators.medians import medians
from rankpanel.plans import boosting, fitted, intervals, models, search, training
from rankpanel.session import scratch_path

SPACE = {"depth": search.IntRange(2, 9), "rate": search.FloatRange(0.001, 0.5, log=True), "leaf": search.IntRange(1, 100, log=True)}


def bowl(params, fold):
    return (params["depth"] - 6) ** 2 / 20 + (math.log10(params["rate"]) + 1.5) ** 2 + math.log10(params["leaf"]) / 4 + 0.01 * fold


def test_equal_seeds_give_equal_trials_whatever_the_pool():
    runs = [search.search(SPACE, bowl, 5, seed=3, parallelism=p) for p in (1, 4)]
    assert [(t.number, t.params, t.losses) for t in runs[0]] == [(t.number, t.params, t.losses) for t in runs[1]]
    assert [t.params for t in search.search(SPACE, bowl, 5, seed=4)] != [t.params for t in runs[0]]


def test_draws_stay_in_their_ranges_and_the_budget_holds():
    met = []
    trials = search.search(SPACE, lambda p, f: met.append(f) or bowl(p, f), 5, max_trials=30, seed=1)
    assert len(trials) == 30 and len(met) == sum(len(t.losses) for t in trials) < 30 * 5
    for t in trials:
        assert isinstance(t.params["depth"], int) and 2 <= t.params["depth"] <= 9
        assert 0.001 <= t.params["rate"] <= 0.5 and 1 <= t.params["leaf"] <= 100
    done = [t for t in trials if t.complete]
    assert done and all(len(t.losses) == 5 for t in done) and trials[0].complete


def test_density_ratio_beats_uniform_draws():
    best = [search.search(SPACE, bowl, 3, max_trials=40, seed=s)[0].loss for s in range(8)]
    plain = [search.search(SPACE, bowl, 3, max_trials=40, seed=s, startup=100)[0].loss for s in range(8)]
    assert np.mean(best) < np.mean(plain)


def test_time_budget_ends_the_rounds():
    assert len(search.search(SPACE, bowl, 2, max_trials=30, batch=5, max_seconds=0.0)) == 5
    assert search.rungs(5, 0.5) == [1, 2, 4, 5] and search.rungs(1, 0.5) == [1]


def test_games_have_equal_best_answers():
    rng = np.random.default_rng(0)
    for _ in range(60):
        m = rng.normal(size=(rng.integers(1, 12), rng.integers(1, 6)))
        x, value = convex_weights.solve_game(m)
        assert x.min() >= -1e-9 and x.sum() == pytest.approx(1) and (m @ x).max() == pytest.approx(value, abs=1e-8)
        tries = rng.dirichlet(np.ones(m.shape[1]), 400)
        assert (m @ tries.T).max(axis=0).min() >= value - 1e-8


def test_exact_weights_against_a_fine_grid(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        y = rng.random() * 10
        rows.append((i % 3, y, y + rng.gauss(1, 2), y * 0.8 + rng.gauss(0, 1), rng.random() * 10))
    rows += [(0, None, 1.0, 1.0, 1.0), (1, 2.0, None, 1.0, 1.0), (9, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "seg int, y double, a double, b double, c double")
    got = {r["seg"]: r for r in convex_weights.exact_mae_weights(df, "y", ["a", "b", "c"], ["seg"], min_rows=10).collect()}
    assert set(got) == {0, 1, 2}
    grid = np.array([(i, j, 100 - i - j) for i in range(101) for j in range(101 - i)]) / 100
    for seg, r in got.items():
        data = np.array([x[1:] for x in rows if x[0] == seg and None not in x])
        direct = np.abs(data[:, 0][:, None] - data[:, 1:] @ grid.T).mean(axis=0).min()
        assert r["mae"] <= direct + 1e-9 and abs(r["mae"] - direct) < 1e-3 and 0 <= r["mae"] - r["bound"] <= 1e-6
        w = np.array([r["w_a"], r["w_b"], r["w_c"]])
        assert w.min() >= 0 and w.sum() == pytest.approx(1)
        assert np.abs(data[:, 0] - data[:, 1:] @ w).mean() == pytest.approx(r["mae"], abs=1e-9)
    one = convex_weights.exact_mae_weights(df, "y", ["a"]).first()
    assert one["w_a"] == 1.0


@pytest.fixture(scope="module")
def scores(spark):
    rng = random.Random(4)
    rows = []
    for year in (2000, 2001):
        for race_num in range(1, 13):
            places = list(range(1, 11))
            rng.shuffle(places)
            for d, y in enumerate(places):
                rows.append((year, race_num, d, float(y), y + rng.gauss(0, 2), y + rng.gauss(0, 4), 11 - y + rng.gauss(0, 3)))
    return spark.createDataFrame(rows, "Year int, Race_Num int, Driver long, y double, a double, b double, c double")


@pytest.mark.parametrize("metric", ["spearman", "ndcg"])
def test_race_has_the_winner_of_scoring_all(scores, metric):
    vectors = racing.candidates(3, 60, seed=5)
    ranked, met = racing.race(scores, "y", ["a", "b", "c"], metric, vectors, blocks=6)
    whole, all_met = racing.race(scores, "y", ["a", "b", "c"], metric, vectors, blocks=1)
    first, best = ranked.orderBy(F.desc("score"), "candidate").first(), whole.orderBy(F.desc("score"), "candidate").first()
    assert (first["candidate"], first["score"]) == (best["candidate"], pytest.approx(best["score"], abs=1e-9))
    assert all_met == [64] and met[0] == 64 and met[-1] < 64
    assert all(sum(v) == pytest.approx(1) and min(v) >= 0 for v in vectors) and len(set(vectors)) == 64


@pytest.mark.parametrize("metric", ["spearman", "ndcg"])
def test_race_is_the_same_by_tasks_and_by_rows_times_candidates(spark, scores, metric, monkeypatch):
    monkeypatch.setattr(racing, "CHUNK", 5)
    vectors = racing.candidates(3, 8, seed=5)  # three chunks
    tied = scores.withColumns({c: F.round(c) for c in "abc"})  # equal blends, and an event without variance
    tied = tied.withColumns({c: F.when((F.col("Year") == 2000) & (F.col("Race_Num") == 3), F.lit(2.0)).otherwise(F.col(c)) for c in "abc"})
    tasks = {r["candidate"]: r["score"] for r in racing.race(tied, "y", ["a", "b", "c"], metric, vectors, blocks=1)[0].collect()}
    spark.conf.set("spark.rankpanel.maxGroupRows", "9")
    try:
        rows = {r["candidate"]: r["score"] for r in racing.race(tied, "y", ["a", "b", "c"], metric, vectors, blocks=1)[0].collect()}
    finally:
        spark.conf.unset("spark.rankpanel.maxGroupRows")
    assert len(rows) > 0 and tasks == pytest.approx(rows, abs=2e-9)


@pytest.mark.parametrize("metric", ["spearman", "ndcg"])
def test_ranking_weights_order_events_in_their_task(spark, scores, metric, monkeypatch):
    tied = scores.withColumns({c: F.round(c) for c in "abc"}).unionByName(scores.where("Year = 2000 AND Race_Num = 1 AND Driver < 2").withColumn("Year", F.lit(1999)))
    spark.conf.set("spark.rankpanel.maxGroupRows", "9")
    try:
        rows = ensemble.ranking_weights(tied, "y", ["a", "b", "c"], metric=metric).first()
    finally:
        spark.conf.unset("spark.rankpanel.maxGroupRows")

    def none(*_):
        raise AssertionError("rows were multiplied by candidates")

    holes = tied.withColumn("a", F.when(F.col("Driver") > 0, F.col("a")))
    assert ensemble.ranking_weights(holes, "y", ["a", "b", "c"], metric=metric).first()["score"] is not None
    monkeypatch.setattr(ensemble, "event_rank_correlation", none)
    monkeypatch.setattr(ensemble, "event_dcg_ratio", none)
    tasks = ensemble.ranking_weights(tied, "y", ["a", "b", "c"], metric=metric).first()
    assert tuple(tasks) == pytest.approx(tuple(rows), abs=2e-9)


def test_race_does_not_shuffle_rows_times_candidates(spark, scores):
    vectors = racing.candidates(3, 252, seed=5)
    plan = racing.event_scores(scores, "y", ["a", "b", "c"], "ndcg", vectors, range(len(vectors)), 24)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == text.count("rangepartitioning") == 1 and "candidate" not in text.split("Exchange")[1]


def test_medians_of_columns_and_groups(spark):
    rng = random.Random(8)
    rows = [(i % 3, rng.gauss(0, 1e6), float(rng.randrange(3)), None, float("nan") if i % 2 else 1.0, 5.0) for i in range(3001)]
    rows += [(3, 1e308, None, None, None, 1.0), (3, -1e308, 1.0, None, None, 2.0), (4, float("inf"), 1.0, None, None, 3.0), (4, 2.0, 1.0, None, None, 4.0), (4, 1.0, 1.0, None, None, 4.0)]
    names = ["a", "b", "c", "d", "e"]
    df = spark.createDataFrame(rows, "g int, a double, b double, c double, d double, e double")
    for buckets in (2, 1024):
        got = {(r["g"], r["feature"]): r["median"] for r in medians(df, names, ["g"], buckets).collect()}
        for g in range(5):
            for i, name in enumerate(names):
                values = [r[i + 1] for r in rows if r[0] == g and r[i + 1] is not None and not math.isnan(r[i + 1])]
                assert ((g, name) in got) == bool(values)
                if values:
                    half = sorted(values)[(len(values) - 1) // 2], sorted(values)[len(values) // 2]
                    assert got[g, name] == half[0] + (half[1] - half[0]) * 0.5
    assert medians(df.where("g > 99"), names).collect() == []


def test_medians_do_not_multiply_rows_by_columns(spark):
    from rankpanel.operators import medians as module

    df = spark.range(3000).select((F.col("id") % 3).alias("g"), F.rand(1).alias("a"), F.rand(2).alias("b"))
    groups = module._ends(df, ["a", "b"], ["g"])
    ranges = [(r["_g"], c, 0.0, 1.0) for r in groups.collect() for c in ("a", "b")]
    counted = module._counted(df, groups, ["g"], ranges, 64)
    text = counted._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in text and "MapInArrow" in text and counted.agg(F.sum("n")).first()[0] == 6000


def test_medians_of_many_groups_and_of_a_null_group(spark, monkeypatch):
    from rankpanel.operators import medians as module

    df = spark.range(4000).select((F.col("id") % 40).alias("g"), F.rand(1).alias("a"), F.when(F.col("id") % 3 > 0, F.rand(2)).alias("b"))
    tasks = {(r["g"], r["feature"]): r["median"] for r in medians(df, ["a", "b"], ["g"]).collect()}
    monkeypatch.setattr(module, "MAX_RANGES", 10)
    assert len(tasks) == 80 and {(r["g"], r["feature"]): r["median"] for r in medians(df, ["a", "b"], ["g"]).collect()} == tasks
    monkeypatch.undo()
    holes = df.withColumn("g", F.when(F.col("g") > 0, F.lit(1)))
    assert {(r["g"], r["feature"]) for r in medians(holes, ["a", "b"], ["g"]).collect()} == {(g, c) for g in (None, 1) for c in "ab"}


def test_median_shuffles_do_not_grow_with_rows(spark):
    df = spark.range(20_000).select((F.col("id") % 7).cast("double").alias("a"), F.rand(1).alias("b"))
    from rankpanel.operators.medians import _bucket, _long

    counted = _long(df, ["a", "b"], []).groupBy("feature", _bucket(F.col("value"), F.lit(0.0), F.lit(7.0), 64).alias("k")).count()
    text = counted._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in text


def direct_derivatives(rows):
    gain = lambda y: 2 ** (1 / max(1, y)) - 1
    out = {}
    for d, y, s in rows:
        g = h = 0.0
        for e, z, t in rows:
            if y < z:
                w = (gain(y) - gain(z)) * math.exp(t - s)
                g, h = g - w, h + w
            elif z < y:
                w = (gain(z) - gain(y)) * math.exp(s - t)
                g, h = g + w, h + w
        out[d] = (g, h)
    return out


@pytest.mark.parametrize("limit", [None, "7"])
def test_pair_derivatives_equal_all_pairs(spark, limit):
    rng = random.Random(6)
    events = {(2000, r): [(d, float(rng.randrange(1, 9)), rng.gauss(0, 1)) for d in range(12)] for r in range(3)}
    df = spark.createDataFrame([(y, r, d, p, s) for (y, r), rows in events.items() for d, p, s in rows], "Year int, Race_Num int, Driver long, y double, s double")
    if limit:
        spark.conf.set("spark.rankpanel.maxGroupRows", limit)
    try:
        got = boosting.pair_derivatives(df, "y", "s").collect()
    finally:
        spark.conf.unset("spark.rankpanel.maxGroupRows")
    assert len(got) == 36
    want = {k: direct_derivatives(rows) for k, rows in events.items()}
    for r in got:
        assert (r["gradient"], r["hessian"]) == pytest.approx(want[r["Year"], r["Race_Num"]][r["Driver"]], abs=1e-9)


def test_a_tree_shuffles_no_rows(spark, scores):
    rows = training.vectors(scores, ["a", "b", "c"]).select(*boosting.KEY, "y", "features").withColumn("_score", F.lit(0.0))
    laid = boosting.laid_out(rows, "y", (10, 240)).persist()
    assert laid.count() == 240
    steps = boosting.newton_steps(laid, "y", (10, 240))
    plan = steps._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    assert "Exchange" not in plan and steps.count() == boosting.newton_steps(rows, "y", (10, 240)).count()
    laid.unpersist()
    boosting.fit_ranker(rows, ["a", "b", "c"], iterations=7, depth=2)
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == 0


def test_ranker_learns_an_order(spark, scores):
    rows = training.vectors(scores, ["a", "b", "c"])
    ranker = boosting.fit_ranker(rows.where("Year = 2000"), ["a", "b", "c"], val=rows.where("Year = 2001"), iterations=6, depth=3)
    assert 1 <= len(ranker.trees) <= 6 and ranker.trace[-1] == max(ranker.trace)
    ordered = ranker.transform(rows.where("Year = 2001"))
    from rankpanel.operators import splits

    corr = ensemble.event_rank_correlation(splits.score_ranks(ordered, "prediction", "r"), "y", "r", ["Year", "Race_Num"])
    assert corr.agg(F.avg("spearman")).first()[0] > 0.5


def test_early_stopping_and_trace(spark, scores):
    rows = training.vectors(scores, ["a", "b", "c"])
    gbt = GBTRegressor(featuresCol="features", labelCol="y", maxIter=25, maxDepth=3, stepSize=0.3, seed=1, validationTol=0.01)
    model, trace = boosting.fit_stopped(gbt, rows.where("Year = 2000"), rows.where("Year = 2001"))
    assert len(trace) == model.getNumTrees < 25
    table = spark.createDataFrame([("gbt", 0, i + 1, x) for i, x in enumerate(trace)] + [("gbt", 1, 1, 2.0), ("gbt", 1, 2, 1.0), ("gbt", 1, 3, 1.0)], boosting.TRACE)
    best = {r["fold"]: r["best_iteration"] for r in boosting.best_iterations(table).collect()}
    assert best == {0: int(np.argmin(trace)) + 1, 1: 2}
    assert boosting.refit(gbt, rows, 2.0).getNumTrees == 2


def test_pipeline_scores_the_same_after_loading(spark, scores):
    names = ["a", "b", "c"]
    data = scores.withColumns({"DNF": (F.col("Driver") % 3 == 0).cast("int"), "Circuit_Cluster": F.col("Race_Num") % 2, "Is_Sprint": F.lit(0)})
    rows = training.vectors(data, names)
    line = LinearRegression(featuresCol="features", labelCol="y").fit(rows)
    ranker = boosting.fit_ranker(rows, names, iterations=2)
    dnf = fitted.calibrated_dnf(rows.where("Year = 2000"), rows.where("Year = 2001"))
    weights = spark.createDataFrame([(0, 0, 0.25, 0.75)], "Circuit_Cluster int, Is_Sprint int, w_linear double, w_rank double")
    pipeline = models.scoring_pipeline(names, {"a": 1.5, "b": None, "c": 2.0}, {"linear": line}, ranker, {"linear": 0.5, "rank": 0.5}, ["Circuit_Cluster", "Is_Sprint"], weights, dnf)
    path = scratch_path(spark, "pipeline")
    models.save_model(pipeline, path)
    loaded = models.load_model(spark, path)
    assert isinstance(loaded, PipelineModel) and loaded.stages[0].defaults() == {"a": 1.5, "b": 0.0, "c": 2.0}
    holes = data.withColumn("a", F.when(F.col("Driver") > 0, F.col("a")))
    a, b = (m.transform(holes).select("Year", "Race_Num", "Driver", "linear", "rank", "blend", "dnf_prob").orderBy("Year", "Race_Num", "Driver").collect() for m in (pipeline, loaded))
    assert a == b and len(a) == data.count()
    assert all(0 <= r["dnf_prob"] <= 1 for r in a)
    even = [r for r in a if r["Race_Num"] % 2 == 0]
    assert all(r["blend"] == pytest.approx(0.25 * r["linear"] + 0.75 * r["rank"]) for r in even)
    with pytest.raises(ValueError):
        loaded.transform(data.drop("b"))


def test_intervals_cover_new_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 10, 6000)
    y = 2 * x + (0.5 + 0.3 * x) * rng.standard_normal(6000)
    df = spark.createDataFrame([(i % 3, i // 3 % 2, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "part int, seg int, x double, y double")
    lines = intervals.fit_lines(df.where("part = 0"), "y", ["x"])
    lines = intervals.conform(lines, df.where("part = 1"), "y", ["seg"])
    bounds = lines.bounds(df.where("part = 2"))
    row = intervals.coverage(bounds, "y").first()
    assert row["ordered"] and 0.77 < row["inside"] < 0.83
    width = {k: v for k, v in bounds.groupBy((F.col("x") > 5).alias("k")).agg(F.avg(F.col("Upper") - F.col("Lower"))).collect()}
    assert width[True] > 1.4 * width[False]


def test_classifier_calibration_uses_other_rows(spark, scores):
    rows = training.vectors(scores.withColumn("DNF", (F.col("a") > 8).cast("int")), ["a", "b"])
    classifier, calibrator = fitted.calibrated_dnf(rows.where("Year = 2000"), rows.where("Year = 2001"))
    assert isinstance(classifier, type(LogisticRegression(labelCol="y").fit(rows.withColumn("y", F.col("DNF").cast("double")))))
    assert calibrator.boundaries.size > 0


def test_fits_side_by_side_stay_within_the_memory(spark):
    room = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().values().head()._1()
    row = training.ROW_OBJECTS + 4 * (36 + 12)
    few, two, many = 1000, int(training.FIT_SHARE * room / row / 2.5), int(room / row * 3)
    assert [training.fits_at_once(spark, n, 36, 12) for n in (0, few, two, many)] == [4, 4, 2, 1]


def test_search_runs_as_many_fits_as_a_fold_allows():
    import threading
    import time

    lock, running, most = threading.Lock(), {}, {}

    def slow(params, fold):
        with lock:
            running[fold] = running.get(fold, 0) + 1
            most[fold] = max(most.get(fold, 0), running[fold])
        time.sleep(0.02)
        with lock:
            running[fold] -= 1
        return bowl(params, fold)

    trials = search.search(SPACE, slow, 3, max_trials=12, seed=3, parallelism=[4, 2, 1])
    assert most[0] > 1 and most[1] <= 2 and most[2] == 1
    assert [(t.number, t.params, t.losses) for t in trials] == [(t.number, t.params, t.losses) for t in search.search(SPACE, bowl, 3, max_trials=12, seed=3)]


def test_ranked_validation_rows_give_the_plain_loss(spark, scores):
    tied = scores.withColumn("y", F.when((F.col("Year") == 2000) & (F.col("Driver") < 4), F.lit(2.0)).otherwise(F.col("y")))
    rows = training.vectors(tied, ["a", "b"]).select("Year", "Race_Num", "Driver", "y", "features")
    train = training.even_parts(rows, "even", rows=50)
    sizes = [r[0] for r in train.groupBy(F.input_file_name()).count().select("count").collect()]
    assert train.count() == 240 and len(sizes) >= 4 and max(sizes) < 240 / 2
    model = LinearRegression(featuresCol="features", labelCol="y").fit(train)
    plain = training.validation_loss(model.transform(rows), "spearman")
    assert training.ranked_rows(rows, "ranked").loss(model) == pytest.approx(plain, abs=1e-12)


@pytest.mark.parametrize("limit", [None, "7"])
def test_ranker_equals_one_grown_row_by_row(spark, scores, limit, monkeypatch):
    names = ["a", "b", "c"]
    tied = scores.withColumns({"y": F.when((F.col("Race_Num") == 4) & (F.col("Driver") < 4), F.lit(2.0)).otherwise(F.col("y")), "c": F.round(F.col("c") / 4)})
    rows = training.vectors(tied, names)
    drawn, bin_limits = [], boosting.bin_limits
    monkeypatch.setattr(boosting, "bin_limits", lambda *a: drawn.append(bin_limits(*a)) or drawn[-1])
    if limit:
        spark.conf.set("spark.rankpanel.maxGroupRows", limit)
    try:
        ranker = boosting.fit_ranker(rows, names, val=rows, iterations=7, patience=99, depth=3)
    finally:
        spark.conf.unset("spark.rankpanel.maxGroupRows")
    data = tied.orderBy("Year", "Race_Num", "Driver").toPandas()
    x, score, trace = data[names].to_numpy(), np.zeros(len(data)), []

    def grown(at, g, h, depth, limits):
        best, whole = None, g[at].sum() ** 2 / h[at].sum()
        for f in range(3 if depth else 0):
            for t in limits[f]:
                left = x[at, f] <= t
                if left.any() and not left.all():
                    gained = sum(g[at[m]].sum() ** 2 / h[at[m]].sum() for m in (left, ~left)) - whole
                    if gained > 1e-9 and (best is None or gained > best[0] * (1 + 1e-9)):
                        best = gained, at[left], at[~left]
        if best is None:
            score[at] += 0.3 * -g[at].sum() / h[at].sum()
        else:
            for part in best[1:]:
                grown(part, g, h, depth - 1, limits)

    for _ in range(7):
        g, h = np.zeros(len(data)), np.zeros(len(data))
        for _, event in data.groupby(["Year", "Race_Num"]):
            want = direct_derivatives([(i, event["y"][i], score[i]) for i in event.index])
            for i in event.index:
                g[i], h[i] = want[i]
        grown(np.flatnonzero(h > 0), g, h, 3, drawn[0])
        ratio = []
        for _, event in data.assign(s=score).groupby(["Year", "Race_Num"]):
            dcg = [sum((2 ** (1 / max(1, p)) - 1) / math.log2(i + 2) for i, p in enumerate(event.sort_values([by, "Driver"], ascending=[up, True])["y"])) for by, up in (("s", False), ("y", True))]
            ratio.append(dcg[0] / dcg[1])
        trace.append(np.mean(ratio))
    kept = int(np.argmax(trace)) + 1
    assert len(ranker.trees) == kept and ranker.trace == pytest.approx(trace[:kept], abs=1e-9)
    if kept == 7:
        got = ranker.transform(rows).orderBy("Year", "Race_Num", "Driver").select("prediction").toPandas()["prediction"].to_numpy()
        assert got == pytest.approx(score, abs=1e-9)


def test_ranker_keeps_a_row_per_event(spark, scores, monkeypatch):
    made = []
    grow = boosting.grow
    monkeypatch.setattr(boosting, "grow", lambda rows, *more: made.append(rows.count()) or grow(rows, *more))
    boosting.fit_ranker(training.vectors(scores, ["a", "b", "c"]), ["a", "b", "c"], iterations=2, depth=2)
    assert made == [24, 24]
