"""Quality classifier from positive and unlabelled text.

Trusted positives and unlabelled web text are enough: with the class prior p,
the risk of calling a document bad is estimated as the unlabelled risk minus p
times the positive risk, and kept from going below zero while training (the
non-negative estimator). The model is additive and piecewise linear over shape
features of the whole text, so scoring is one DataFrame expression.

The features are computed for every document in one scan. Feature means and
spreads and the class prior come from all training rows; only the fit itself
uses hash-chosen samples of at most ``sample`` positives and as many unlabelled
rows (expected number, a documented bound).

Rows: one per input row. Null and empty texts have all features 0 and are
scored like any other; repeated rows each count; documents with both labels are
not trusted positives; without any positive or unlabelled training row every
score is the prior (0.5 if there is none); an empty table gives an empty
result. Other columns are ignored by ``score`` and kept by ``keep_good``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankpanel.llm.tables import WORD
from rankpanel.session import materialize

SAMPLE = 20_000
STEPS, RATE, DECAY = 600, 0.05, 1e-4
CLIP = 4.0
NAMES = (
    "upper", "symbols", "bangs", "digits", "stops", "commas", "runs", "word_length", "short_words", "distinct", "repeats", "line_repeats", "size",
)


def shape_features(text: Column) -> dict[str, Column]:
    """Language-independent features of a whole text."""
    t = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(t), F.lit(1)).cast("double")
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    n = F.greatest(F.size(words), F.lit(1)).cast("double")
    lines = F.split(t, "\n")

    def per(pattern: str, of: Column) -> Column:
        return F.sqrt(F.regexp_count(t, F.lit(pattern)) / of)

    return {
        "upper": per(r"\p{Lu}", chars),
        "symbols": per(r"[#$%&*|~^=<>{}\\@_/+]", chars),
        "bangs": per("!", chars),
        "digits": per("[0-9]", chars),
        "stops": per(r"[.?]", n),
        "commas": per(",", n),
        "runs": per(r"([#$%&*!|])\1", n),
        "word_length": F.log1p(F.length(t) / n),
        "short_words": F.size(F.filter(words, lambda w: F.length(w) <= 3)) / n,
        "distinct": F.log1p(F.size(F.array_distinct(words)).cast("double")) / F.log1p(n),
        "repeats": F.size(F.filter(words, lambda w: F.length(w) > 3)) / F.greatest(F.size(F.array_distinct(F.filter(words, lambda w: F.length(w) > 3))), F.lit(1)),
        "line_repeats": F.log1p(F.size(lines) / F.greatest(F.size(F.array_distinct(lines)), F.lit(1))),
        "size": F.log1p(n),
    }


def in_training(key: Column) -> Column:
    """The fold whose labels may be learnt from."""
    return F.crc32(key.cast("string").cast("binary")) % 3 != 1


@dataclass(frozen=True)
class Model:
    """Weights of the two hinges of every standardised feature."""

    mean: tuple[float, ...]
    spread: tuple[float, ...]
    above: tuple[float, ...]
    below: tuple[float, ...]
    bias: float
    prior: float

    def score(self, features: dict[str, Column]) -> Column:
        z = F.lit(self.bias)
        for name, m, s, a, b in zip(NAMES, self.mean, self.spread, self.above, self.below):
            x = F.least(F.greatest((features[name] - m) / s, F.lit(-CLIP)), F.lit(CLIP))
            z = z + F.greatest(x, F.lit(0.0)) * a + F.greatest(-x, F.lit(0.0)) * b
        return 1 / (1 + F.exp(-z))


def minimise_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias with the least non-negative unbiased logistic risk (Adam, full batches)."""
    w, b = np.zeros(positive.shape[1]), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    squash = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def mean_gradient(x: np.ndarray, g: np.ndarray) -> np.ndarray:
        return np.append(x.T @ g, g.sum()) / len(x)

    for step in range(1, STEPS + 1):
        zp, zu = positive @ w + b, unlabelled @ w + b
        sp, su = squash(zp), squash(zu)
        bad = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        bad_gradient = mean_gradient(unlabelled, su) - prior * mean_gradient(positive, sp)
        if bad >= 0:
            g = prior * mean_gradient(positive, sp - 1) + bad_gradient
        else:
            g = -bad_gradient
        g[:-1] += DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - float(move[-1])
    return w, b


def fit(features: DataFrame, labels: DataFrame, key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Fit on the training fold of a table of key and features."""
    marks = labels.where(F.col("quality").isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min("quality").alias("_good"))
    train = features.where(in_training(F.col(key))).join(marks, F.col(key) == F.col("_key"), "left")
    stats = train.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("_good") == 1, 1)).alias("good"),
        F.count("_good").alias("labelled"),
        *[F.mean(c).alias(f"m_{c}") for c in NAMES],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in NAMES],
    ).first()
    prior = stats["good"] / stats["labelled"] if stats["labelled"] else 0.5
    prior = min(max(prior, 0.01), 0.99)
    mean = np.array([stats[f"m_{c}"] or 0.0 for c in NAMES])
    spread = np.array([max(stats[f"s_{c}"] or 0.0, 1e-6) for c in NAMES])
    order = F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.lit(1 << 32)) / float(1 << 32)

    def hinges(rows: DataFrame, total: int) -> np.ndarray:
        got = rows.where(order < min(1.0, sample / max(total, 1))).select(*NAMES)
        x = np.array(sorted(tuple(r) for r in got.collect()), dtype=float).reshape(-1, len(NAMES))
        z = np.clip((x - mean) / spread, -CLIP, CLIP)
        return np.hstack([np.maximum(z, 0), np.maximum(-z, 0)])

    positive = hinges(train.where(F.col("_good") == 1), stats["good"])
    unlabelled = hinges(train, stats["n"])
    k = len(NAMES)
    w, b = np.zeros(2 * k), float(np.log(prior / (1 - prior)))
    if len(positive) and len(unlabelled):
        w, b = minimise_risk(positive, unlabelled, prior)
    t = lambda a: tuple(float(x) for x in a)
    return Model(t(mean), t(spread), t(w[:k]), t(w[k:]), float(b), prior)


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """Per document: key, held_out, score and predicted (1 from a score of 0.5 on)."""
    table = materialize(docs.select(F.col(key).alias(key), *[c.alias(n) for n, c in shape_features(F.col("text")).items()]), "shape")
    model = fit(table, labels, key, sample)
    scored = table.withColumn("score", model.score({n: F.col(n) for n in NAMES}))
    held = F.coalesce(~in_training(F.col(key)), F.lit(False))
    return scored.select(key, held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """The documents the model accepts. The features are computed once for the fit and once for the filter."""
    features = shape_features(F.col("text"))
    table = materialize(docs.select(F.col(key).alias(key), *[c.alias(n) for n, c in features.items()]), "shape")
    model = fit(table, labels, key, sample)
    return docs.where(model.score(features) >= 0.5)
