"""Ensemble weights of the best mean ranking metric, by an exact race of many candidates.

Candidates are the unit vectors, the uniform one and seeded draws. Events come in
blocks; after each block a candidate has its sum so far, and every event to come
can add at most 1 and at least the metric's minimum. A candidate whose highest
reachable mean is below the lowest mean the leader can end with is out. So the
winner is that of scoring all candidates on all events, and candidates that can
no longer win cost nothing further.

Later blocks only meet the candidates that are left. An event's rows are shuffled
once per ``CHUNK`` candidates, and the task that has them orders them by each one.
Events beyond ``maxGroupRows`` are multiplied by the candidates instead and ordered
by range blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankpanel.operators.ensemble import EVENT, event_dcg_ratio, event_rank_correlation
from rankpanel.operators.ordering import group_sizes
from rankpanel.session import join_small, materialize, max_group_rows

#: Modulus and multipliers of the candidate draws; SQL can state them as they are.
PRIME, BY_CANDIDATE, BY_MODEL, BY_SEED = 1_000_003, 7_919, 104_729, 15_485_863
#: The least value a metric can have in an event.
FLOOR = {"spearman": -1.0, "ndcg": 0.0}


def draw(candidate: int, models: int, seed: int) -> tuple[float, ...]:
    """Weights spread evenly over the simplex: normalised logarithms of a multiplicative sequence."""
    logs = []
    for j in range(models):
        x = (candidate * BY_CANDIDATE + (j + 1) * BY_MODEL + seed * BY_SEED) % PRIME
        x = x * x % PRIME * (j + 2) % PRIME  # squares break the lattice of a linear sequence
        logs.append(-math.log((x + 1) / (PRIME + 1)))
    total = sum(logs)
    return tuple(round(v / total, 9) for v in logs)


def candidates(models: int, draws: int = 1000, seed: int = 42) -> list[tuple[float, ...]]:
    """Uniform, the unit vectors, then the draws; equal scores go to the earlier one."""
    units = [tuple(float(i == j) for j in range(models)) for i in range(models)]
    return [tuple(1.0 / models for _ in range(models)), *units, *[draw(i + 1, models, seed) for i in range(draws)]]


#: Candidates that meet an event's rows in one task.
CHUNK = 128


def _rounded(values: np.ndarray) -> np.ndarray:
    """Nine digits, halves away from zero, as Spark's ``round``."""
    return np.copysign(np.floor(np.abs(values) * 1e9 + 0.5) / 1e9, values)


def _average_ranks(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Average ranks in the given order; equal values share theirs."""
    line = values[order]
    starts = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    counts = np.diff(np.append(starts, len(line)))
    return np.repeat(starts + (counts + 1) / 2.0, counts)


def _scorer(target: str, models: Sequence[str], metric: str, vectors: Sequence[Sequence[float]], alive: Sequence[int]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Rows of one event and one chunk of candidates to (candidate, score); no score without variance."""
    models, wanted = list(models), [(i, tuple(float(x) for x in vectors[i])) for i in alive]

    def score(rows: pd.DataFrame) -> pd.DataFrame:
        chunk, n = int(rows["chunk"].iloc[0]), len(rows)
        rows = rows.sort_values("Driver", kind="stable")  # equal scores go to the smaller driver
        y, columns = rows[target].to_numpy(float), [rows[m].to_numpy(float) for m in models]
        if metric == "spearman":
            order = np.argsort(y, kind="stable")
            truth = np.empty(n)
            truth[order] = _average_ranks(y, order) - (n + 1) / 2.0
            spread = math.sqrt(float(truth @ truth))
        else:
            gain = np.exp2(1.0 / np.maximum(1.0, y)) - 1.0
            discount = 1.0 / np.log2(np.arange(1, n + 1) + 1.0)
            ideal = float(gain[np.argsort(np.maximum(1.0, y), kind="stable")] @ discount)
        out = []
        for i, w in wanted[chunk * CHUNK : (chunk + 1) * CHUNK]:
            blend = np.zeros(n)
            for column, x in zip(columns, w):
                blend = blend + column * x
            blend = _rounded(blend)
            if metric == "spearman":
                order = np.argsort(blend)
                ranks = _average_ranks(blend, order) - (n + 1) / 2.0
                both = spread * math.sqrt(float(ranks @ ranks))
                out.append((i, float(truth[order] @ ranks) / both if both > 0 else None))
            else:
                order = np.argsort(np.maximum(1.0, blend), kind="stable")
                out.append((i, float(gain[order] @ discount) / ideal if ideal > 0 else 0.0))
        return pd.DataFrame(out, columns=["candidate", metric]).astype({"candidate": "int32", metric: "float64"})

    return score


def event_scores(rows: DataFrame, target: str, models: Sequence[str], metric: str, vectors: Sequence[Sequence[float]], alive: Sequence[int], events: int) -> DataFrame:
    """(candidate, metric) of every event of ``rows``, which have no missing values, and every candidate in ``alive``."""
    chunks = math.ceil(len(alive) / CHUNK)
    split = rows.select(*EVENT, "Driver", target, *models).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    spread = split.repartitionByRange(max(1, events * chunks), *EVENT, "chunk")
    return spread.groupBy(*EVENT, "chunk").applyInPandas(_scorer(target, models, metric, vectors, alive), f"candidate int, {metric} double")


def event_blocks(oof: DataFrame, blocks: int) -> DataFrame:
    """(event, block): events spread evenly by a hash, so that every block is a fair sample."""
    return oof.select(*EVENT).distinct().withColumn("block", F.pmod(F.xxhash64(*EVENT), F.lit(blocks)).cast("int"))


def _multiplied(part: DataFrame, target: str, models: Sequence[str], metric: str, vectors: Sequence[Sequence[float]], alive: Sequence[int], largest: tuple[int, int], min_rows: int) -> DataFrame:
    """The scores of ``event_scores`` for events too large for a task: rows times candidates, ordered by range blocks."""
    table = part.sparkSession.createDataFrame([(i, [float(x) for x in vectors[i]]) for i in alive], "candidate int, w array<double>").coalesce(1)
    listed = table.agg(F.collect_list(F.struct("candidate", "w"))).scalar()  # as many entries as candidates
    total = F.lit(0.0)
    for j, m in enumerate(models):
        total = total + F.col(m) * F.element_at("_c.w", j + 1)
    tried = part.withColumn("_c", F.explode(listed)).select(*EVENT, "Driver", target, F.col("_c.candidate").alias("candidate"), F.round(total, 9).alias("blend"))
    sizes = (largest[0], largest[1] * len(alive))
    keys = ["candidate", *EVENT]
    return event_rank_correlation(tried, target, "blend", keys, sizes, min_rows) if metric == "spearman" else event_dcg_ratio(tried, target, "blend", keys, sizes, min_rows)


def race(
    oof: DataFrame, target: str, models: Sequence[str], metric: str = "spearman", vectors: Sequence[Sequence[float]] | None = None, blocks: int = 8, min_rows: int = 3
) -> tuple[DataFrame, list[int]]:
    """((candidate, score, events) of the candidates that finished, best first, and how many candidates met each block)."""
    spark = oof.sparkSession
    vectors = list(candidates(len(models)) if vectors is None else vectors)
    rows = oof.na.drop(subset=[target, *models]).select(*EVENT, "Driver", target, *models)
    # An event counts if it is large enough and its target has variance; both do not depend on the candidate.
    counted = rows.groupBy(*EVENT).agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(target).alias("_k"))
    counted = counted.where((F.col("_n") >= min_rows) & ((F.col("_k") > 1) | F.lit(metric != "spearman")))
    placed = materialize(join_small(rows, event_blocks(counted, blocks), EVENT, "blocks", "inner"), "race", ("block",))
    per_block = {r["block"]: r["n"] for r in placed.select("block", *EVENT).distinct().groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}
    largest = group_sizes(placed, EVENT)
    events, done = sum(per_block.values()), 0
    alive, sums, met = list(range(len(vectors))), [0.0] * len(vectors), []
    for block in sorted(per_block):
        met.append(len(alive))
        part = placed.where(F.col("block") == block)
        if largest[0] <= max_group_rows(spark):
            score = event_scores(part, target, models, metric, vectors, alive, per_block[block])
        else:
            score = _multiplied(part, target, models, metric, vectors, alive, largest, min_rows)
        # A blend without variance orders nothing: no correlation.
        found = score.groupBy("candidate").agg(F.sum(F.coalesce(metric, F.lit(0.0))).alias("s")).collect()  # one row per candidate
        for r in found:
            sums[r["candidate"]] += r["s"]
        done += per_block[block]
        left = events - done
        safe = max(sums[i] for i in alive) + left * FLOOR[metric]
        # The margin covers the rounding of sums.
        alive = [i for i in alive if sums[i] + left >= safe - 1e-6]
    ranked = sorted(alive, key=lambda i: (-round(sums[i] / max(1, events), 9), i))
    out = [(i, round(sums[i] / max(1, events), 9), events, [float(x) for x in vectors[i]]) for i in ranked]
    return spark.createDataFrame(out, "candidate int, score double, events long, weights array<double>"), met


def race_weights(oof: DataFrame, target: str, models: Sequence[str], metric: str = "spearman", draws: int = 1000, seed: int = 42, blocks: int = 8) -> DataFrame:
    """(candidate, score, w_<model>...) of the winner."""
    ranked, _ = race(oof, target, models, metric, candidates(len(models), draws, seed), blocks)
    best = ranked.orderBy(F.desc("score"), "candidate").limit(1)
    return best.select("candidate", "score", *[F.element_at("weights", i + 1).alias(f"w_{m}") for i, m in enumerate(models)])
