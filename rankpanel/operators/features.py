"""Panel features: lagged history of entities, circuit attributes, gaps, interactions.

Driver history runs on panel rows. Team history first sums each team's entries
per event, so it lags by event: a team-mate's result in the same event is never
visible, and the shuffle carries team-events instead of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankpanel.functions.columns import day_clock_seconds, with_suffix
from rankpanel.operators.ordering import average_ranks, exact_quantiles, group_sizes
from rankpanel.operators.timeline import Ewm, Frame, lagged_ewm, lagged_frames
from rankpanel.session import join_small, materialize, max_group_rows

EVENT = ["Year", "Race_Num"]
METRICS = ("Position", "Quali_Pos", "DNF")
# Window names and lengths.
WINDOWS = {"short": 3, "medium": 5, "long": 10, "season": 23}
# Default circuit categories.
CATEGORIES = {
    "street": ("Monaco", "Singapore", "Azerbaijan", "Las Vegas", "Miami", "Saudi Arabian"),
    "high_speed": ("Italian", "Belgian", "British", "Japanese", "Bahrain"),
    "technical": ("Hungarian", "Spanish", "Abu Dhabi"),
}
# Names of the circuit attributes.
ATTRIBUTES = (
    "Pit_Loss_Time",
    "Overtake_Difficulty",
    "Expected_Pit_Stops",
    "SC_Probability",
    "Track_Pos_Importance",
    "Tyre_Degradation",
)


@dataclass(frozen=True)
class Lag:
    """One lagged column of an entity.

    ``mean``: rolling mean over ``size`` earlier events; ``ewm``: weighted mean
    with span ``size``; ``total``: running total, null on the first event;
    ``points``: running total, 0 where there is no previous value. ``scope``
    adds grouping columns that are fixed within an event.
    """

    out: str
    kind: str
    source: str
    size: int | None = None
    scope: tuple[str, ...] = ()


def _frames(lag: Lag, team: bool) -> list[Frame]:
    if lag.kind == "mean":
        if team:
            return [
                Frame(f"_s_{lag.out}", "sum", f"_sum_{lag.source}", lag.size),
                Frame(f"_n_{lag.out}", "sum", f"_cnt_{lag.source}", lag.size),
            ]
        return [Frame(lag.out, "avg", lag.source, lag.size)]
    source = f"_sum_{lag.source}" if team else lag.source
    if lag.kind == "total":
        return [Frame(lag.out, "sum", source)]
    if lag.kind == "points":
        return [Frame(f"_t_{lag.out}", "sum", source), Frame(f"_p_{lag.out}", "max", source, 1)]
    raise ValueError(lag.kind)


def _finish(lag: Lag, team: bool) -> str:
    if lag.kind == "mean" and team:
        return f"try_divide(`_s_{lag.out}`, nullif(`_n_{lag.out}`, 0)) AS `{lag.out}`"
    if lag.kind == "points":
        return f"coalesce(CASE WHEN `_p_{lag.out}` IS NOT NULL THEN CAST(`_t_{lag.out}` AS DOUBLE) END, 0D) AS `{lag.out}`"
    return f"CAST(`{lag.out}` AS DOUBLE) AS `{lag.out}`"


def history_sizes(df: DataFrame, entity: str, events: int | None = None) -> tuple[int, int]:
    """Bound on an entity's rows: it has one row per event, so the number of events bounds it.

    Only when there are more events than a group may hold are entities counted.
    """
    bound = events if events is not None else df.select(*EVENT).distinct().count()
    return (bound, bound) if bound <= max_group_rows(df.sparkSession) else group_sizes(df, [entity])


def _apply(df: DataFrame, entity: str, lags: Sequence[Lag], team: bool, events: int | None) -> DataFrame:
    """All lags of one entity, grouped by scope so that equal partitionings are adjacent."""
    keep = df.columns
    sizes = history_sizes(df, entity, events)
    small = sizes if sizes[0] <= max_group_rows(df.sparkSession) else None
    for scope in dict.fromkeys(lag.scope for lag in lags):
        keys = [entity, *scope]
        frames = [f for lag in lags if lag.scope == scope and lag.kind != "ewm" for f in _frames(lag, team)]
        ewms = [
            Ewm(lag.out, f"_avg_{lag.source}" if team else lag.source, lag.size)
            for lag in lags
            if lag.scope == scope and lag.kind == "ewm"
        ]
        known = sizes if not scope else small
        # weighted means need the most helper columns, so they run on the narrowest rows
        if ewms:
            df = lagged_ewm(df, keys, ewms, EVENT, known)
        if frames:
            df = lagged_frames(df, keys, frames, EVENT, known)
    return df.selectExpr(*[f"`{c}`" for c in keep], *[_finish(lag, team) for lag in lags])


def driver_history(df: DataFrame, lags: Sequence[Lag], events: int | None = None) -> DataFrame:
    return _apply(df, "Driver", lags, team=False, events=events)


def team_history(
    df: DataFrame, lags: Sequence[Lag], best: dict[str, str] | None = None, events: int | None = None
) -> DataFrame:
    """Lags per team plus, in ``best``, minima within the team-event: one aggregate, one join back."""
    scope = sorted({c for lag in lags for c in lag.scope} - set(EVENT))
    sources = list(dict.fromkeys(lag.source for lag in lags))
    per_event = df.groupBy("Team", *EVENT).agg(
        *[F.max(c).alias(c) for c in scope],
        *[F.sum(c).alias(f"_sum_{c}") for c in sources],
        *[F.count(c).alias(f"_cnt_{c}") for c in sources],
        *[F.avg(c).alias(f"_avg_{c}") for c in sources],
        *[F.min(c).alias(out) for out, c in (best or {}).items()],
    )
    history = _apply(per_event, "Team", lags, team=True, events=events) if lags else per_event
    outs = [*(lag.out for lag in lags), *(best or {})]
    side = history.select("Team", *EVENT, *outs)
    return join_small(df, side, ["Team", *EVENT], "team-history").select(*df.columns, *outs)


def rolling_lags(entity: str, metrics: Sequence[str] = METRICS, windows: dict[str, int] = WINDOWS) -> list[Lag]:
    return [Lag(f"{entity}_Avg_{m}_{w}", "mean", m, k) for m in metrics for w, k in windows.items()]


def ewm_lags(entity: str, metrics: Sequence[str] = METRICS, spans: dict[str, int] = WINDOWS) -> list[Lag]:
    return [Lag(f"{entity}_EWM_{m}_{s}", "ewm", m, k) for m in metrics for s, k in spans.items()]


def sprint_lags(entity: str) -> list[Lag]:
    return [Lag(f"{entity}_Sprint_Count_Prev", "total", "Is_Sprint")]


def championship_lags(entity: str) -> list[Lag]:
    return [Lag(f"{entity}_Season_Points", "points", "Points", scope=("Year",))]


def cluster_lags(entity: str) -> list[Lag]:
    return [
        Lag(f"{entity}_Cluster_Avg_Quali", "mean", "Quali_Pos", 5, ("Circuit_Cluster",)),
        Lag(f"{entity}_Cluster_Avg_Race", "mean", "Position", 5, ("Circuit_Cluster",)),
    ]


def uplift_lags(entity: str) -> list[Lag]:
    return [Lag(f"{entity}_Cluster_Uplift", "mean", "Grid_Delta", 6, ("Circuit_Cluster",))]


def category_flags(df: DataFrame, categories: dict[str, Sequence[str]] = CATEGORIES) -> DataFrame:
    """``CircuitType_*`` flags, matching names with and without the suffix."""
    name = with_suffix(F.col("Circuit"))
    flags = {}
    for cat, members in categories.items():
        full = [m if m.endswith(" Grand Prix") else f"{m} Grand Prix" for m in members]
        flags[f"CircuitType_{cat}"] = F.coalesce(name.isin(*full).cast("int"), F.lit(0))
    return df.withColumns(flags)


def circuit_attributes(df: DataFrame, circuits: DataFrame, attributes: Sequence[str] = ATTRIBUTES) -> DataFrame:
    """Numeric attributes per circuit; unknown ones get the row-weighted median, else 0.

    The panel is counted per circuit once; medians and fills happen on that
    table, which is then joined back.
    """
    rows = df.groupBy("Circuit").agg(F.count(F.lit(1)).alias("_rows"))
    known = circuits.select(
        with_suffix(F.col("Circuit")).alias("_name"), *[F.col(a).cast("double").alias(a) for a in attributes]
    )
    present = materialize(rows.withColumn("_name", with_suffix(F.col("Circuit"))).join(known, "_name", "left"), "circuits")
    medians = _weighted_medians(present, attributes)
    filled = present.select("Circuit", *[F.coalesce(F.col(a), F.lit(medians.get(a) or 0.0)).alias(a) for a in attributes])
    return join_small(df, filled, ["Circuit"], "circuit-attributes").select(*df.columns, *attributes)


def _weighted_medians(present: DataFrame, attributes: Sequence[str]) -> dict[str, float]:
    """Medians per attribute; one number per attribute reaches the driver."""
    if present.count() <= max_group_rows(present.sparkSession):
        row = present.agg(*[F.percentile(a, F.lit(0.5), F.col("_rows")).alias(a) for a in attributes]).first()
        return row.asDict()
    long = present.unpivot("_rows", list(attributes), "attribute", "value")
    medians = exact_quantiles(long, "value", {"median": 0.5}, ["attribute"], weight="_rows")
    return {r["attribute"]: r["median"] for r in medians.collect()}


def circuit_clusters(df: DataFrame, k: int = 4, seed: int = 42) -> DataFrame:
    """k-means over circuits, weighted by rows; labels follow the order of the centres.

    Returns (Circuit, Circuit_Cluster). All zeros when k is 1 or exceeds the distinct rows.
    """
    inputs = sorted(c for c in df.columns if c.startswith("CircuitType_")) + ["Pit_Loss_Time", "Overtake_Difficulty"]
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in inputs}
    points = df.groupBy("Circuit").agg(
        F.count(F.lit(1)).cast("double").alias("_rows"), *[F.max(e).alias(c) for c, e in filled.items()]
    )
    # one row per circuit; written once because fitting reads it many times
    points = materialize(points, "circuits")
    if k <= 1 or points.select(*inputs).distinct().count() < k:
        return points.select("Circuit", F.lit(0).alias("Circuit_Cluster"))
    vectors = VectorAssembler(inputCols=inputs, outputCol="_x").transform(points)
    model = KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="_label", weightCol="_rows").fit(vectors)
    order = sorted(range(k), key=lambda i: tuple(model.clusterCenters()[i]))
    rank = F.element_at(F.array(*[F.lit(order.index(i)) for i in range(k)]), F.col("_label") + 1)
    return model.transform(vectors).select("Circuit", rank.alias("Circuit_Cluster"))


def cluster_aggregates(df: DataFrame) -> DataFrame:
    if "Circuit_Cluster" not in df.columns:
        return df
    outs = {"Cluster_Avg_SC_Prob": "SC_Probability", "Cluster_Avg_Overtake": "Overtake_Difficulty", "Cluster_Avg_PitLoss": "Pit_Loss_Time"}
    means = df.groupBy("Circuit_Cluster").agg(*[F.avg(c).alias(o) for o, c in outs.items()])
    return join_small(df, means, ["Circuit_Cluster"], "cluster-means").select(*df.columns, *outs)


def team_form_gap(df: DataFrame) -> DataFrame:
    """Driver form minus team form over the short window, where both exist."""
    pairs = {"Teammate_Gap_Quali_short": "Quali_Pos", "Teammate_Gap_Race_short": "Position"}
    new = {
        out: F.col(f"Driver_Avg_{m}_short") - F.col(f"Team_Avg_{m}_short")
        for out, m in pairs.items()
        if {f"Driver_Avg_{m}_short", f"Team_Avg_{m}_short"} <= set(df.columns)
    }
    return df.withColumns(new) if new else df


def sprint_flag(df: DataFrame) -> DataFrame:
    flag = F.coalesce(F.col("Is_Sprint").cast("int"), F.lit(0)) if "Is_Sprint" in df.columns else F.lit(0)
    return df.withColumn("Is_Sprint", flag)


# Rain, temperature and wind limits.
def weather_flags(
    df: DataFrame, rain: float = 30, best_range: tuple[float, float] = (20, 30), wind: float = 25
) -> DataFrame:
    if not {"AirTemp", "Humidity", "Pressure", "WindSpeed", "Rainfall"} <= set(df.columns):
        return df
    middle = sum(best_range) / 2.0

    def above(c: str, limit: float) -> Column:
        return F.coalesce(F.col(c) > limit, F.lit(False)).cast("int")

    return df.withColumns(
        {
            "is_wet_race": above("Rainfall", rain),
            "temp_deviation": F.abs(F.col("AirTemp") - middle),
            "is_windy": above("WindSpeed", wind),
        }
    )


def season_progress(df: DataFrame, rounds: DataFrame | None = None) -> DataFrame:
    """Round over the season's last round: the schedule's when given, else the last one seen.

    One row per year is broadcast; calendar years bound it.
    """
    if not set(EVENT) <= set(df.columns):
        return df
    source = rounds.select("Year", F.col("RoundNumber").alias("Race_Num")) if rounds is not None else df
    last = source.groupBy("Year").agg(F.max("Race_Num").alias("_last"))
    share = F.try_divide(F.col("Race_Num").cast("double"), F.nullif(F.col("_last"), F.lit(0)).cast("double"))
    return df.join(F.broadcast(last), "Year", "left").select(*df.columns, F.coalesce(share, F.lit(0.0)).alias("Season_Progress"))


def quali_gap_to_team(df: DataFrame) -> DataFrame:
    if not {"Team", "Quali_Pos"} <= set(df.columns):
        return df
    joined = team_history(df, [], {"_best": "Quali_Pos"})
    return joined.withColumn("Quali_Delta_Teammate", F.col("Quali_Pos") - F.col("_best")).drop("_best")


def quali_seconds(df: DataFrame) -> DataFrame:
    """Session times in seconds and the best available one, latest session first."""
    have = [c for c in ("Q1", "Q2", "Q3") if c in df.columns]
    if not have:
        return df
    df = df.withColumns({f"{c}_s": day_clock_seconds(F.col(c)) for c in have})
    return df.withColumn("Quali_Time_s", F.coalesce(*[F.col(f"{c}_s") for c in reversed(have)]))


def quali_gap_to_pole(df: DataFrame) -> DataFrame:
    """Gap to the event's best time; the minimum combines before the shuffle."""
    if "Quali_Time_s" not in df.columns:
        df = quali_seconds(df)
    if "Quali_Time_s" not in df.columns:
        return df
    best = df.groupBy(*EVENT).agg(F.min("Quali_Time_s").alias("_pole"))
    gap = F.col("Quali_Time_s") - F.col("_pole")
    return join_small(df, best, EVENT, "event-best").select(
        *df.columns,
        gap.alias("Quali_Gap_To_Pole"),
        F.try_divide(gap, F.nullif(F.col("_pole"), F.lit(0.0))).alias("Quali_Gap_Pct"),
    )


def grid_delta(df: DataFrame) -> DataFrame:
    """Places lost from the grid. An outcome of the same event: never a model input."""
    if not {"Grid", "Position"} <= set(df.columns):
        return df
    return df.withColumn("Grid_Delta", F.col("Position") - F.col("Grid"))


def adjusted_grid_delta(df: DataFrame) -> DataFrame:
    if not {"Grid_Delta", "Overtake_Difficulty"} <= set(df.columns):
        return df
    ranked = average_ranks(df, "Overtake_Difficulty", [], "_pct", pct=True)
    return ranked.withColumn("Adj_Grid_Delta", F.col("Grid_Delta") * (1.0 - F.col("_pct"))).drop("_pct")


def interactions(df: DataFrame) -> DataFrame:
    have, new = set(df.columns), {}
    for e in ("Driver", "Team"):
        if {f"{e}_Avg_Position_short", "Overtake_Difficulty"} <= have:
            new[f"{e}_FormShort_x_Overtake"] = F.col(f"{e}_Avg_Position_short") * F.col("Overtake_Difficulty")
    if {"Grid", "Track_Pos_Importance"} <= have:
        zero = F.lit(0.0)
        new["Grid_x_TrackImportance"] = F.coalesce("Grid", zero) * F.coalesce("Track_Pos_Importance", zero)
    return df.withColumns(new) if new else df
