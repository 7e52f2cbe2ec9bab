"""Exact order statistics of many columns and groups at once, by bucket counts.

Every (group, column) has a range of values in which its statistic lies. One
aggregate counts rows, least and greatest value per bucket of that range, for all
groups and columns together; the bucket that holds the wanted rank becomes the
next range. A bucket of one distinct value ends the search. The aggregates have a
fixed number of cells, whatever the rows, and values themselves are never
shuffled: 1,024 buckets leave a thousandth of the rows after each round, and
columns of few distinct values end in the first one.

A task counts the columns of its rows as they are, batch by batch, and sends one
row per bucket that has values. Only with so many groups that a task can't hold
their buckets are rows multiplied by columns and counted by Spark's aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankpanel.session import join_small, materialize

BUCKETS = 1024
#: Ranges whose buckets one task holds: 24 bytes a bucket, 100 MB in all.
MAX_RANGES = 4096
#: The greatest finite double; values beyond it share the outermost buckets.
HUGE = 1.7976931348623157e308


def _long(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, feature, value) of the values that are there; NaN counts as missing."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    rows = df.select(*keys, F.inline(cells))
    return rows.where(F.col("value").isNotNull() & ~F.isnan("value"))


def _bucket(value: Column, low: Column, high: Column, buckets: int) -> Column:
    """Place of a value among equal parts of a range; halves keep the width finite."""
    v, a, b = (F.least(F.lit(HUGE), F.greatest(F.lit(-HUGE), x)) / 2 for x in (value, low, high))
    place = F.floor((v - a) / F.when(b > a, b - a).otherwise(F.lit(1.0)) * buckets)
    return F.when(b > a, F.least(F.lit(buckets - 1), F.greatest(F.lit(0), place))).otherwise(F.when(value > low, buckets - 1).otherwise(0)).cast("int")


def _ends(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One row per group: its ``_g`` and, per column, how many values there are and the least and greatest of them."""
    out = []
    for i, c in enumerate(columns):
        value = F.col(c).cast("double")
        value = F.when(~F.isnan(value), value)  # null for null and NaN
        out += [F.count(value).alias(f"_n{i}"), F.min(value).alias(f"_low{i}"), F.max(value).alias(f"_high{i}")]
    groups = df.groupBy(*keys).agg(*out) if keys else df.agg(*out)
    return materialize(groups.withColumn("_g", F.monotonically_increasing_id()), "median-ends")


def _counter(ranges: Sequence[tuple[int, str, float, float]], buckets: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with ``_g`` to (range, bucket, n, low, high); ``ranges`` are (group, column, low, high).

    Its parts are nested, so that tasks need not import this package.
    """
    huge = HUGE

    def placed(values: np.ndarray, low: float, high: float) -> np.ndarray:
        """``_bucket`` for an array."""
        a, b = max(-huge, min(huge, low)) / 2, max(-huge, min(huge, high)) / 2
        if b > a:
            part = (np.clip(values, -huge, huge) / 2 - a) / (b - a) * buckets
            return np.clip(np.floor(part), 0, buckets - 1).astype(np.int64)
        return np.where(values > low, buckets - 1, 0)

    wanted: dict[int, list[tuple[int, str, float, float]]] = {}
    for i, (g, c, low, high) in enumerate(ranges):
        wanted.setdefault(g, []).append((i, c, low, high))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            group = batch.column("_g").to_numpy(zero_copy_only=False)
            columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c != "_g"}
            for g in np.unique(group).tolist():
                own = slice(None) if (group == g).all() else np.flatnonzero(group == g)
                for i, c, low, high in wanted.get(g, ()):
                    values = columns[c][own]
                    values = np.sort(values[(values >= low) & (values <= high)])  # without NaN, which nulls are too
                    if not len(values):
                        continue
                    places = placed(values, low, high)
                    starts = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
                    ends = np.append(starts[1:], len(values))
                    if i not in cells:
                        cells[i] = np.zeros(buckets, np.int64), np.full(buckets, np.inf), np.full(buckets, -np.inf)
                    n, least, most = cells[i]
                    at = places[starts]
                    n[at] += ends - starts
                    least[at] = np.minimum(least[at], values[starts])
                    most[at] = np.maximum(most[at], values[ends - 1])
        for i, (n, least, most) in cells.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(at.astype(np.int32)), pa.array(n[at]), pa.array(least[at]), pa.array(most[at])], ["range", "bucket", "n", "low", "high"])

    return count


def _counted(df: DataFrame, groups: DataFrame, keys: Sequence[str], ranges: Sequence[tuple[int, str, float, float]], buckets: int) -> DataFrame:
    """(range, bucket, n, low, high) over all rows; ``groups`` has (keys, _g), one row per group."""
    used = list(dict.fromkeys(c for _, c, _, _ in ranges))
    values = [F.col(c).cast("double").alias(c) for c in used]
    if keys:
        side = groups.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_g")
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        rows = df.join(F.broadcast(side), same).select(F.col("_g"), *values)
    else:
        rows = df.select(F.lit(ranges[0][0]).cast("long").alias("_g"), *values)
    parts = rows.mapInArrow(_counter(ranges, buckets), "range int, bucket int, n long, low double, high double")
    return parts.groupBy("range", "bucket").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def medians(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), buckets: int = BUCKETS) -> DataFrame:
    """(keys, feature, median) of every column in every group that has a value; exact, halves between middle values."""
    keys, columns, spark = list(keys), list(columns), df.sparkSession
    ends = _ends(df, columns, keys)
    if ends.count() * len(columns) > MAX_RANGES:
        return _medians_by_rows(df, columns, keys, buckets)
    # (group, column, side) -> (rank, low, high) of both middle ranks; as many entries as groups times columns.
    targets: dict[tuple[int, str, int], tuple[int, float, float]] = {}
    for r in ends.collect():
        for i, c in enumerate(columns):
            if r[f"_n{i}"]:
                for q in (0, 1):
                    targets[r["_g"], c, q] = ((r[f"_n{i}"] - 1 + q) // 2, r[f"_low{i}"], r[f"_high{i}"])
    groups = ends.select(*keys, "_g")
    while open_ := {k: t for k, t in targets.items() if t[1] < t[2]}:
        ranges = list(dict.fromkeys((g, c, low, high) for (g, c, _), (_, low, high) in open_.items()))
        number = {r: i for i, r in enumerate(ranges)}
        asked = [(number[g, c, low, high], q, rank) for (g, c, q), (rank, low, high) in open_.items()]
        upto = F.sum("n").over(Window.partitionBy("range").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        counted = _counted(df, groups, keys, ranges, buckets).withColumn("upto", upto).join(F.broadcast(spark.createDataFrame(asked, "range int, side int, rank long")), "range")
        hit = counted.where((F.col("upto") - F.col("n") <= F.col("rank")) & (F.col("rank") < F.col("upto")))
        for r in hit.collect():  # one row per entry of asked
            g, c, _, _ = ranges[r["range"]]
            targets[g, c, r["side"]] = (r["rank"] - (r["upto"] - r["n"]), r["low"], r["high"])
    found = [(g, c, low + (targets[g, c, 1][1] - low) * 0.5) for (g, c, q), (_, low, _) in targets.items() if q == 0]
    return spark.createDataFrame(found, "_g long, feature string, median double").join(F.broadcast(groups), "_g").select(*keys, "feature", "median")


def _medians_by_rows(df: DataFrame, columns: Sequence[str], keys: Sequence[str], buckets: int) -> DataFrame:
    """``medians`` for any number of groups: rows times columns, counted by one aggregate a round."""
    by = [*keys, "feature"]
    ends = _long(df, columns, keys).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    # Both middle ranks, which are one for an odd count.
    ranks = F.array(*[F.struct(F.lit(q).alias("side"), F.floor((F.col("n") - 1 + q) / 2).alias("rank")) for q in (0, 1)])
    targets = materialize(ends.select(*by, "low", "high", F.inline(ranks)), "median-ranges")
    found = targets.where("low = high")
    while not (open_ := targets.where("low < high")).isEmpty():
        rows = join_small(_long(df, columns, keys), open_, by, "median-targets", "inner").where(F.col("value").between(F.col("low"), F.col("high")))
        counted = rows.groupBy(*by, "side", "rank", _bucket(F.col("value"), F.col("low"), F.col("high"), buckets).alias("bucket")).agg(
            F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
        )
        upto = F.sum("n").over(Window.partitionBy(*by, "side").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        before = F.col("upto") - F.col("n")
        hit = counted.withColumn("upto", upto).where((before <= F.col("rank")) & (F.col("rank") < F.col("upto")))
        targets = materialize(hit.select(*by, "low", "high", "side", (F.col("rank") - before).alias("rank")), "median-ranges")
        found = found.unionByName(targets.where("low = high"))
    halves = F.max(F.when(F.col("side") == 0, F.col("low"))), F.max(F.when(F.col("side") == 1, F.col("low")))
    return found.groupBy(*by).agg((halves[0] + (halves[1] - halves[0]) * F.lit(0.5)).alias("median"))
