"""Mix sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time t in [0, 1]. Its integral
gives the share of each source, water-filling turns shares into word targets
that stop at a number of epochs, and a document's place in the source's
cumulative demand is inverted through the schedule to a training position.
Positions order the output by one range sort.

Rows: one per input row. Null or empty texts have size 0 and take nothing; a
null source is a source of its own, last in order; repeated rows each count;
equal positions are ordered by document id; an empty table gives an empty
result; other columns are ignored by ``plan`` and kept by ``apply_plan``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankpanel.llm.tables import WORD, numbered_blocks, word_count
from rankpanel.operators.ordering import row_numbers, value_counts_before
from rankpanel.session import materialize

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
EPOCHS = 2
#: Knots of training time, and per source weight the demand at the knots: heavy sources grow, light ones fade.
KNOTS = (0.0, 0.5, 1.0)
RAMPS = ((0.5, 1.0, 1.5), (1.0, 1.0, 1.0), (1.5, 1.0, 0.5))


def schedule_integral(knots: Sequence[float], heights: Sequence[float]) -> tuple[list[float], list[float]]:
    """Densities at the knots scaled to integrate to 1, and the integral up to each knot."""
    steps = list(zip(knots, knots[1:], heights, heights[1:]))
    area = sum((b - a) * (x + y) / 2 for a, b, x, y in steps)
    density = [h / area for h in heights]
    upto = [0.0]
    for a, b, x, y in zip(knots, knots[1:], density, density[1:]):
        upto.append(upto[-1] + (b - a) * (x + y) / 2)
    return density, upto


def invert_schedule(u: Column, knots: Sequence[float], heights: Sequence[float]) -> Column:
    """The time at which a share ``u`` of a source's demand has been met.

    Inside a segment the integral is quadratic; the root is taken in the form
    that stays exact when the density is flat.
    """
    density, upto = schedule_integral(knots, heights)
    out = F.lit(float(knots[-1]))
    for k in reversed(range(len(knots) - 1)):
        slope = (density[k + 1] - density[k]) / (knots[k + 1] - knots[k])
        d = F.greatest(u - upto[k], F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(density[k] ** 2) + 2 * slope * d, F.lit(0.0)))
        t = knots[k] + 2 * d / F.greatest(density[k] + root, F.lit(1e-300))
        out = F.when(u < upto[k + 1], F.least(t, F.lit(float(knots[k + 1])))).otherwise(out)
    return out


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS
) -> DataFrame:
    """Per source its size, rank, weight and target: ``least(epochs * size, level * weight)``.

    The level is where the targets add up to ``share`` of all sizes: sources are
    ordered by the level at which they are full, and the first that is not full
    at the level its predecessors leave fixes it. Runs on one row per source.
    """
    per = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    per = row_numbers(per, [], [F.col("source").asc_nulls_last()], "rank")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    per = materialize(
        per.withColumn("weight", pick).withColumn("full_at", epochs * F.col("source_size") / F.col("weight")), "sources"
    )
    levels = materialize(per.groupBy("full_at").agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")), "levels")
    before = value_counts_before(levels.select("full_at", F.col("s").alias("n")), [], "full_at").withColumnRenamed("before", "s0")
    heavier = value_counts_before(levels.select("full_at", F.col("w").alias("n")), [], "full_at").withColumnRenamed("before", "w0")
    total = levels.agg(F.sum("s").alias("all_s"), F.sum("w").alias("all_w")).first()
    all_s, all_w = total["all_s"] or 0, total["all_w"] or 0.0
    level = (
        before.join(heavier, "full_at")
        .select("full_at", ((share * all_s - epochs * F.col("s0")) / (all_w - F.col("w0"))).alias("level"))
        .where(F.col("level") <= F.col("full_at"))
        .agg(F.min_by("level", "full_at").alias("level"))
        .first()["level"]
    )
    reached = F.lit(float("inf") if level is None else float(level))
    return per.withColumn("target", F.least((epochs * F.col("source_size")).cast("double"), reached * F.col("weight"))).drop("full_at")


def plan(
    docs: DataFrame,
    key: str = "doc_id",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    epochs: int = EPOCHS,
    knots: Sequence[float] = KNOTS,
    ramps: Sequence[Sequence[float]] = RAMPS,
) -> DataFrame:
    """What the mix takes of every document, and when.

    Returns key, source, size, source_size, target, ``taken`` (words, repeats
    counted) and ``copies``: an array of (words, position), one per pass over
    the source. A source is passed through in the order of a hash of the key;
    pass e of a document covers the words [e * source_size + before, + size) of
    the source's demand, of which the part below the target is taken. So the
    taken words of a source add up to its rounded target, and one document per
    source may be taken in part.
    """
    sizes = docs.select(F.col(key).alias(key), F.col("source").alias("source"), word_count(F.col("text")).alias("size"))
    sizes = materialize(sizes, "sizes")
    targets = source_targets(sizes, weights, share, epochs)
    order = F.xxhash64(F.col(key))
    blocks = numbered_blocks(
        sizes.withColumn("_order", order), [F.col("source"), F.col("_order"), F.col(key)], "_block", "mix-blocks"
    )
    same = [F.col("source"), F.col("_block")]
    totals = blocks.groupBy("source", "_block").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("carry", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    totals = totals.select(F.col("source").alias("_s"), F.col("_block").alias("_b"), "carry")
    totals = totals.join(targets, F.col("_s").eqNullSafe(F.col("source"))).drop("source", "weight")
    inside = Window.partitionBy(*same).orderBy("_order", key).rowsBetween(Window.unboundedPreceding, -1)
    run = blocks.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    run = run.join(totals, (F.col("_block") == F.col("_b")) & F.col("source").eqNullSafe(F.col("_s")))
    start = F.col("carry") + F.col("_in")
    goal = F.round("target").cast("long")
    copies = []
    for e in range(epochs):
        lo = e * F.col("source_size") + start
        words = F.greatest(F.least(lo + F.col("size"), goal) - lo, F.lit(0))
        u = (lo + words / 2) / F.greatest(F.col("target"), F.lit(1.0))
        ramp = (F.col("rank") - 1) % len(ramps)
        at = invert_schedule(u, knots, ramps[0])
        for i in range(1, len(ramps)):
            at = F.when(ramp == i, invert_schedule(u, knots, ramps[i])).otherwise(at)
        copies.append(F.when(words > 0, F.struct(words.alias("words"), at.alias("position"))))
    return run.select(
        key, "source", "size", "source_size", "target", F.array_compact(F.array(*copies)).alias("copies")
    ).withColumn("taken", F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"]))


def by_position(planned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Range-sort documents by their first position; those not taken come last."""
    out = planned.withColumn("position", F.get("copies", F.lit(0))["position"]).withColumn("again_at", F.get("copies", F.lit(1))["position"])
    order = [F.col("position").asc_nulls_last(), F.col(key)]
    return out.drop("copies").repartitionByRange(*order).sortWithinPartitions(*order)


def apply_plan(docs: DataFrame, key: str = "doc_id", **settings) -> DataFrame:
    """The mixed documents in training order: a row per copy, the columns of ``docs``.

    A copy taken in part keeps its first words, joined by one space. Repeated or null keys are told apart by a row number written first.
    """
    narrow = docs.groupBy(key).count().agg(F.max("count").alias("most"), F.max(F.col(key).isNull()).alias("null")).first()
    columns, row = docs.columns, key
    if (narrow["most"] or 0) > 1 or narrow["null"]:
        row = "_row"
        docs = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    chosen = plan(docs, row, **settings).where(F.size("copies") > 0)
    chosen = chosen.select(F.col(row).alias("_r"), F.col("size").alias("_size"), F.explode("copies").alias("_copy"))
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.col("_copy.words").cast("int")), " ")
    mixed = docs.join(chosen, F.col(row) == F.col("_r")).withColumn("_at", F.col("_copy.position"))
    cut = F.col("_copy.words") < F.col("_size")
    mixed = mixed.withColumn("text", F.when(cut, part).otherwise(F.col("text")))
    if "n_chars" in columns:
        mixed = mixed.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    order = [F.col("_at"), F.col(row)]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order).select(*columns)
