"""Lagged frames along an entity's history.

``order`` is the time order inside ``keys``; every frame ends at the row before
the current one, so a row never sees its own outcome. Entities whose history is
within the group limit use plain windows that share one shuffle and one sort.
Longer histories are cut into blocks by sequence number: a block also holds the
last rows of the block before it (the halo a bounded frame needs), and
unbounded frames add the totals of earlier blocks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankpanel.operators.ordering import group_sizes, row_numbers
from rankpanel.session import materialize, max_group_rows

EVENT_ORDER = ("Year", "Race_Num")

#: exp() stays far from overflow below this sum of log decays
LOG_DECAY_LIMIT = 300.0


@dataclass(frozen=True)
class Frame:
    """``agg`` (sum, avg, count or max) of ``source`` over the previous ``rows`` rows; None means all."""

    out: str
    agg: str
    source: str
    rows: int | None = None


_AGGS = {"sum": F.sum, "avg": F.avg, "count": F.count, "max": F.max}


def names(columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}`" for c in columns)


def window(keys: Sequence[str], order: Sequence[str], frame: str = "") -> str:
    partition = f"PARTITION BY {names(keys)} " if keys else ""
    return f"({partition}ORDER BY {names(order)} {frame})"


PAST = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
UP_TO_NOW = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def over(f: Frame, keys: Sequence[str], order: Sequence[str]) -> str:
    """The frame as SQL text: many columns parse faster than they build call by call."""
    rows = f"ROWS BETWEEN {f.rows} PRECEDING AND 1 PRECEDING" if f.rows else PAST
    return f"{f.agg}(`{f.source}`) OVER {window(keys, order, rows)}"


def lagged_frames(
    df: DataFrame,
    keys: Sequence[str],
    frames: Sequence[Frame],
    order: Sequence[str] = EVENT_ORDER,
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """Add every frame in one projection."""
    keys, order = list(keys), list(order)
    largest, total = sizes or group_sizes(df, keys)
    limit = max_group_rows(df.sparkSession)
    if largest <= limit:
        return df.selectExpr("*", *[f"{over(f, keys, order)} AS `{f.out}`" for f in frames])
    return _lagged_in_blocks(df, keys, frames, order, (largest, total), limit)


def _lagged_in_blocks(df, keys, frames, order, sizes, limit):
    reach = max([f.rows for f in frames if f.rows], default=1)
    block_rows = max(limit, 4 * reach)
    seq = row_numbers(df, keys, [F.col(c) for c in order], "_pos", sizes)
    home = F.floor((F.col("_pos") - 1) / block_rows)
    near_end = (F.col("_pos") - 1) % block_rows >= block_rows - reach
    spread = seq.withColumn("_home", home).withColumn(
        "_tb", F.explode(F.when(near_end, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home")))
    )
    w = Window.partitionBy(*keys, "_tb").orderBy("_pos")
    own = F.col("_tb") == F.col("_home")
    local = []
    for f in frames:
        if f.rows:
            local.append(_AGGS[f.agg](f.source).over(w.rowsBetween(-f.rows, -1)).alias(f.out))
        elif f.agg == "avg":
            raise ValueError("an unbounded frame must be sum, count or max")
        else:
            kept = F.when(own, F.col(f.source))
            local.append(_AGGS[f.agg](kept).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_in_{f.out}"))
    rows = spread.select("*", *local).where(own)
    unbounded = [f for f in frames if not f.rows]
    if not unbounded:
        return rows.select(*df.columns, *[f.out for f in frames])
    per_block = seq.withColumn("_tb", home).groupBy(*keys, "_tb").agg(
        *[_AGGS[f.agg](f.source).alias(f"_all_{f.out}") for f in unbounded]
    )
    before = Window.partitionBy(*keys).orderBy("_tb").rowsBetween(Window.unboundedPreceding, -1)
    merge = {"sum": F.sum, "count": F.sum, "max": F.max}
    carry = per_block.select(
        *keys, "_tb", *[merge[f.agg](f"_all_{f.out}").over(before).alias(f"_pre_{f.out}") for f in unbounded]
    )
    joined = rows.join(carry, [*keys, "_tb"], "left")
    outs = []
    for f in frames:
        if f.rows:
            outs.append(F.col(f.out))
            continue
        a, b = F.col(f"_in_{f.out}"), F.col(f"_pre_{f.out}")
        if f.agg == "max":
            outs.append(F.greatest(a, b).alias(f.out))
        else:
            zero = F.lit(0)
            both = F.coalesce(a, zero) + F.coalesce(b, zero)
            outs.append((F.when(a.isNotNull() | b.isNotNull(), both) if f.agg == "sum" else both).alias(f.out))
    return joined.select(*df.columns, *outs)


@dataclass(frozen=True)
class Ewm:
    """Lagged exponentially weighted mean of ``source`` with ``alpha = 2 / (span + 1)``."""

    out: str
    source: str
    span: float


def _step(x: str, gap: str, alpha: float) -> tuple[str, str]:
    """Log decay and input of one recurrence step ``m = exp(decay) * m + input``, as SQL text.

    A value that follows its predecessor by ``gap`` rows meets an old weight of
    ``(1 - alpha) ** gap``; the first value of a history (gap null) starts it.
    """
    keep = f"{gap} * {math.log1p(-alpha)!r}D"
    den = f"(exp({keep}) + {alpha!r}D)"
    decay = f"CASE WHEN {x} IS NOT NULL AND {gap} IS NOT NULL THEN {keep} - ln({den}) ELSE 0D END"
    value = f"CASE WHEN {x} IS NULL THEN 0D WHEN {gap} IS NULL THEN {x} ELSE {alpha!r}D * {x} / {den} END"
    return decay, value


def lagged_ewm(
    df: DataFrame,
    keys: Sequence[str],
    ewms: Sequence[Ewm],
    order: Sequence[str] = EVENT_ORDER,
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """Add lagged exponentially weighted means, without arrays or Python workers.

    The recurrence ``m_i = a_i * m_(i-1) + b_i`` unrolls to
    ``exp(L_i) * sum_j b_j * exp(-L_j)`` with ``L`` the running sum of
    ``ln a``, so it needs only running sums. All terms of one history have
    non-negative weights, so nothing cancels.
    """
    keys, order = list(keys), list(order)
    if any(e.span <= 1 for e in ewms):
        raise ValueError("span must be greater than 1")
    largest, total = sizes or group_sizes(df, keys)
    steepest = max(-math.log1p(-2.0 / (e.span + 1)) for e in ewms)
    if largest <= max_group_rows(df.sparkSession) and largest * steepest <= LOG_DECAY_LIMIT:
        return _ewm_one_window(df, keys, ewms, order)
    return _ewm_segments(df, keys, ewms, order, (largest, total))


def _ewm_one_window(df, keys, ewms, order):
    """Row number, last row with a value, log decay and weighted sum: four window stages, one sort."""
    past, now = window(keys, order, PAST), window(keys, order, UP_TO_NOW)
    metrics = list(dict.fromkeys(e.source for e in ewms))
    n = range(len(ewms))
    steps = [_step(f"_x_{e.source}", f"_gap_{e.source}", 2.0 / (e.span + 1)) for e in ewms]
    out = (
        df.selectExpr(
            "*",
            f"row_number() OVER {window(keys, order)} AS _seq",
            *[f"CAST(`{m}` AS DOUBLE) AS `_x_{m}`" for m in metrics],
        )
        .selectExpr("*", *[f"max(CASE WHEN `_x_{m}` IS NOT NULL THEN _seq END) OVER {past} AS `_last_{m}`" for m in metrics])
        .selectExpr("*", *[f"CAST(_seq - `_last_{m}` AS DOUBLE) AS `_gap_{m}`" for m in metrics])
        .selectExpr("*", *[f"{d} AS _d{i}" for i, (d, _) in enumerate(steps)], *[f"{v} AS _b{i}" for i, (_, v) in enumerate(steps)])
        .selectExpr("*", *[f"sum(_d{i}) OVER {now} AS _l{i}" for i in n])
        .selectExpr("*", *[f"_b{i} * exp(-_l{i}) AS _t{i}" for i in n])
    )
    return out.selectExpr(
        *[f"`{c}`" for c in df.columns],
        *[
            f"CASE WHEN `_last_{e.source}` IS NOT NULL THEN exp(sum(_d{i}) OVER {past}) * sum(_t{i}) OVER {past} END AS `{e.out}`"
            for i, e in enumerate(ewms)
        ],
    )


def _ewm_segments(df, keys, ewms, order, sizes):
    """Histories of any length, all columns in one pass.

    A history is cut every ``limit / steepest decay`` rows, the same for all
    columns, so the terms inside a segment neither overflow nor vanish. What
    earlier segments leave is carried by the recurrence itself, folded over one
    (decay, sum) pair per segment and column. A single gap that decays beyond
    the limit is held at it: older values then weigh below ``exp(-limit)``.
    """
    steepest = max(-math.log1p(-2.0 / (e.span + 1)) for e in ewms)
    segment_rows = max(1, int(LOG_DECAY_LIMIT / steepest))
    metrics = list(dict.fromkeys(e.source for e in ewms))
    n = range(len(ewms))
    numbered = row_numbers(df, keys, [F.col(c) for c in order], "_seq", sizes)
    numbered = numbered.withColumns({f"_at_{m}": F.when(F.col(m).isNotNull(), F.col("_seq")) for m in metrics})
    numbered = lagged_frames(numbered, keys, [Frame(f"_last_{m}", "max", f"_at_{m}") for m in metrics], ["_seq"], sizes)
    numbered = numbered.drop(*[f"_at_{m}" for m in metrics]).withColumn("_seg", F.expr(f"(_seq - 1) div {segment_rows}"))
    rows = materialize(numbered, "histories")
    steps = [_step(f"_x_{e.source}", f"_gap_{e.source}", 2.0 / (e.span + 1)) for e in ewms]
    within = [*keys, "_seg"]
    past, now = window(within, ["_seq"], PAST), window(within, ["_seq"], UP_TO_NOW)
    terms = (
        rows.selectExpr("*", *[f"CAST(`{m}` AS DOUBLE) AS `_x_{m}`" for m in metrics], *[f"CAST(_seq - `_last_{m}` AS DOUBLE) AS `_gap_{m}`" for m in metrics])
        .selectExpr("*", *[f"greatest({d}, {-LOG_DECAY_LIMIT}D) AS _d{i}" for i, (d, _) in enumerate(steps)], *[f"{v} AS _b{i}" for i, (_, v) in enumerate(steps)])
        .selectExpr("*", *[f"sum(_d{i}) OVER {now} AS _l{i}" for i in n])
        .selectExpr("*", *[f"_b{i} * exp(-_l{i}) AS _t{i}" for i in n])
    )
    decays = ", ".join(f"exp(sum(_d{i}))" for i in n)
    sums = ", ".join(f"exp(sum(_d{i})) * sum(_t{i})" for i in n)
    totals = terms.groupBy(*within).agg(F.expr(f"array({decays})").alias("_decay"), F.expr(f"array({sums})").alias("_sum"))
    history = totals.groupBy(*keys).agg(F.expr("sort_array(collect_list(struct(_seg, _decay, _sum)))").alias("_history"))
    folded = F.expr(
        f"""aggregate(_history, named_struct('m', array_repeat(0D, {len(ewms)}), 'out', cast(array() AS array<struct<seg: bigint, m: array<double>>>)),
            (a, s) -> named_struct('m', zip_with(zip_with(a.m, s._decay, (x, y) -> x * y), s._sum, (x, y) -> x + y),
                                   'out', array_append(a.out, named_struct('seg', s._seg, 'm', a.m)))).out"""
    )
    carry = history.select(*keys, F.explode(folded).alias("_c")).select(*keys, F.col("_c.seg").alias("_seg"), F.col("_c.m").alias("_carry"))
    local = terms.selectExpr(
        *[f"`{c}`" for c in df.columns], *([] if "_seg" in df.columns else ["_seg"]), *[f"`_last_{m}`" for m in metrics],
        *[f"exp(coalesce(sum(_d{i}) OVER {past}, 0D)) AS _e{i}" for i in n], *[f"coalesce(sum(_t{i}) OVER {past}, 0D) AS _s{i}" for i in n],
    )
    joined = local.join(carry, within, "left")
    return joined.selectExpr(
        *[f"`{c}`" for c in df.columns],
        *[f"CASE WHEN `_last_{e.source}` IS NOT NULL THEN _e{i} * (_carry[{i}] + _s{i}) END AS `{e.out}`" for i, e in enumerate(ewms)],
    )
