"""Ranks, running totals and exact quantiles that do not depend on small groups.

Each operator has two plans. If the largest group is within
``spark.rankpanel.maxGroupRows`` it is one plain window: one shuffle, one sort.
Otherwise the rows are range-partitioned on (keys, order), so that one group
spreads over many tasks, ordered inside each block, and shifted by the totals
of the blocks before it. Both plans give the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankpanel.session import materialize, max_group_rows, shuffle_partitions

BLOCK = "_block"


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """(rows of the largest group, rows in all); one map-side combined count."""
    if not keys:
        n = df.count()
        return n, n
    row = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.max("n").alias("largest"), F.sum("n").alias("total"))
        .first()
    )
    return row["largest"] or 0, row["total"] or 0


def range_blocks(df: DataFrame, order: Sequence[Column], total: int) -> DataFrame:
    """Range-partition and number the partitions; written once so numbers stay put."""
    spark = df.sparkSession
    n = max(shuffle_partitions(spark), math.ceil(total / max_group_rows(spark)))
    ranged = df.repartitionByRange(n, *order).withColumn(BLOCK, F.spark_partition_id())
    return materialize(ranged, "blocks")


def block_carry(blocks: DataFrame, keys: Sequence[str], totals: dict[str, Column], block: str = BLOCK) -> DataFrame:
    """Per (keys, block): the totals of all earlier blocks of the same keys.

    The window runs over one row per block, not over the rows themselves.
    """
    per_block = blocks.groupBy(*keys, block).agg(*[c.alias(o) for o, c in totals.items()])
    w = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return per_block.select(*keys, block, *[F.sum(o).over(w).alias(o) for o in totals])


def row_numbers(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    out: str,
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """Add the 1-based position of each row within its group."""
    keys = list(keys)
    largest, total = sizes or group_sizes(df, keys)
    if largest <= max_group_rows(df.sparkSession):
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(out, F.row_number().over(w).cast("long"))
    blocks = range_blocks(df, [F.col(k).asc() for k in keys] + list(order), total)
    carry = block_carry(blocks, keys, {"_before": F.count(F.lit(1))})
    w = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    return (
        blocks.withColumn(out, F.row_number().over(w).cast("long"))
        .join(carry, [*keys, BLOCK], "left")
        .withColumn(out, F.col(out) + F.coalesce(F.col("_before"), F.lit(0)))
        .drop("_before", BLOCK)
        .select(*df.columns, out)
    )


def value_counts_before(counts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """To (keys, value, n) add ``before``: rows of the group with a smaller value."""
    keys = list(keys)
    largest, total = group_sizes(counts, keys)
    if largest <= max_group_rows(counts.sparkSession):
        w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    blocks = range_blocks(counts, [F.col(k).asc() for k in keys] + [F.col(value).asc()], total)
    carry = block_carry(blocks, keys, {"_before": F.sum("n")})
    w = Window.partitionBy(*keys, BLOCK).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        blocks.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
        .join(carry, [*keys, BLOCK], "left")
        .withColumn("before", F.col("before") + F.coalesce(F.col("_before"), F.lit(0)))
        .select(*counts.columns, "before")
    )


def value_counts(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """Rows (or summed ``weight``) per distinct value; written once because its size is checked next."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(n.cast("long").alias("n"))
    return materialize(counts, "values")


def average_ranks(
    df: DataFrame,
    value: str,
    keys: Sequence[str],
    out: str,
    pct: bool = False,
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """Add the average rank of ``value`` in its group (ties share it, null stays null).

    With ``pct`` the rank is divided by the number of non-null values. Without
    keys the ranks always come from value counts, never from one window over all rows.
    """
    keys = list(keys)
    present = F.col(value).isNotNull()
    if keys and (sizes or group_sizes(df, keys))[0] <= max_group_rows(df.sparkSession):
        w = Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last())
        upto = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        rank = (F.rank().over(w) + F.count(value).over(upto)) / 2.0
        if pct:
            rank = rank / F.count(value).over(Window.partitionBy(*keys))
        return df.withColumn(out, F.when(present, rank))
    ranked = value_counts_before(value_counts(df, keys, value), keys, value)
    rank = F.col("before") + (F.col("n") + 1) / 2.0
    if pct:
        n = ranked.groupBy(*keys).agg(F.sum("n").alias("_all"))
        ranked = ranked.join(n, keys) if keys else ranked.withColumn("_all", n.scalar())
        rank = rank / F.col("_all")
    ranked = ranked.select(*keys, value, rank.alias(out))
    return df.join(ranked, [*keys, value], "left").select(*df.columns, out)


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    keys: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles per group, from value counts.

    The built-in exact percentile keeps every distinct value of a group in one
    task's memory; here a group spreads over tasks when it is large.
    """
    keys = list(keys)
    ranked = value_counts_before(value_counts(df, keys, value, weight), keys, value)
    size = ranked.groupBy(*keys).agg(F.sum("n").alias("_all"))
    ranked = ranked.join(size, keys) if keys else ranked.withColumn("_all", size.scalar())
    after = F.col("before") + F.col("n")
    ends, outs = [], []
    for name, p in probs.items():
        at = (F.col("_all") - 1) * F.lit(float(p))
        for side, idx in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("before") <= idx) & (idx < after)
            ends.append(F.max(F.when(hit, F.col(value).cast("double"))).alias(f"_{name}_{side}"))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        frac = (F.col("_n") - 1) * F.lit(float(p)) - F.floor((F.col("_n") - 1) * F.lit(float(p)))
        outs.append((lo + (hi - lo) * frac).alias(name))
    return ranked.groupBy(*keys).agg(F.max("_all").alias("_n"), *ends).select(*keys, *outs)
