"""History snapshots: what lagged features of later rows need from all earlier rows of an entity.

Per entity (and scope, such as its circuit cluster) a snapshot keeps the last
rows that bounded frames reach into, running sums, and the state of every
weighted mean (its value and the rows since the last value). Rows of new events
are joined to it: their lagged features are those of the whole history, which is
not read again. A snapshot advanced by new rows equals one taken of everything,
so snapshots are carried from event to event.

All tables have one row per entity and scope, or as many as the longest frame
has rows; they grow with entities, not with history.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankpanel.operators import features as ft
from rankpanel.operators.ordering import group_sizes, row_numbers
from rankpanel.operators.timeline import LOG_DECAY_LIMIT, PAST, UP_TO_NOW, Ewm, Frame, _step, lagged_ewm, lagged_frames, window
from rankpanel.session import materialize

EVENT = ["Year", "Race_Num"]


@dataclass(frozen=True)
class Part:
    """One scope of an entity: ``tail`` has the last rows, ``state`` the sums and weighted means."""

    tail: DataFrame
    state: DataFrame


@dataclass(frozen=True)
class Snapshot:
    entity: str
    lags: tuple[ft.Lag, ...]
    parts: dict[tuple[str, ...], Part] = field(default_factory=dict)

    @property
    def team(self) -> bool:
        return self.entity == "Team"


def _by_scope(lags: Sequence[ft.Lag], team: bool) -> dict[tuple[str, ...], tuple[list[ft.Lag], list[Frame], list[Ewm]]]:
    out = {}
    for scope in dict.fromkeys(lag.scope for lag in lags):
        mine = [lag for lag in lags if lag.scope == scope]
        frames = [f for lag in mine if lag.kind != "ewm" for f in ft._frames(lag, team)]
        ewms = [Ewm(lag.out, f"_avg_{lag.source}" if team else lag.source, lag.size) for lag in mine if lag.kind == "ewm"]
        out[scope] = (mine, frames, ewms)
    return out


def team_events(df: DataFrame, lags: Sequence[ft.Lag]) -> DataFrame:
    """One row per team and event, with sums, counts and means of the lags' sources."""
    scope = sorted({c for lag in lags for c in lag.scope} - set(EVENT))
    sources = list(dict.fromkeys(lag.source for lag in lags))
    return df.groupBy("Team", *EVENT).agg(
        *[F.max(c).alias(c) for c in scope], *[F.sum(c).alias(f"_sum_{c}") for c in sources], *[F.count(c).alias(f"_cnt_{c}") for c in sources], *[F.avg(c).alias(f"_avg_{c}") for c in sources]
    )


def _bounded(frames: Sequence[Frame]) -> list[Frame]:
    return [f for f in frames if f.rows]


def _sums(frames: Sequence[Frame]) -> list[Frame]:
    return [f for f in frames if not f.rows]


def take(history: DataFrame, entity: str, lags: Sequence[ft.Lag], sizes: tuple[int, int] | None = None) -> Snapshot:
    """The snapshot after all rows of ``history``; for teams, after its team events."""
    team = entity == "Team"
    rows = team_events(history, lags) if team else history
    parts = {}
    for scope, (_, frames, ewms) in _by_scope(lags, team).items():
        keys = [entity, *scope]
        parts[scope] = _part(_pruned(rows, keys, frames, ewms), keys, frames, ewms, sizes)
    return Snapshot(entity, tuple(lags), parts)


def _pruned(rows: DataFrame, keys: Sequence[str], frames: Sequence[Frame], ewms: Sequence[Ewm]) -> DataFrame:
    sources = dict.fromkeys([*[f.source for f in frames], *[e.source for e in ewms]])
    return rows.select(*dict.fromkeys([*keys, *EVENT, *sources]))


def _part(rows: DataFrame, keys: list[str], frames: Sequence[Frame], ewms: Sequence[Ewm], sizes: tuple[int, int] | None) -> Part:
    """Tail and state, the latter read off a row that comes after the last one of each key."""
    reach = max([f.rows for f in _bounded(frames)], default=0)
    newest = [F.col(c).desc() for c in EVENT]
    numbered = row_numbers(rows, keys, newest, "_back", sizes)
    tail = materialize(numbered.where(F.col("_back") <= reach).drop("_back"), "snapshot-tail")
    after = rows.select(*keys).distinct()
    nothing = [F.lit(None).cast(t).alias(c) for c, t in rows.dtypes if c not in (*keys, *EVENT)]
    later = rows.agg(F.max("Year")).scalar() + 1
    # A scope that is the year itself stays the row's own.
    events = [*([] if "Year" in keys else [later.cast(rows.schema["Year"].dataType).alias("Year")]), F.lit(1_000_000).cast(rows.schema["Race_Num"].dataType).alias("Race_Num")]
    both = rows.withColumn("_end", F.lit(False)).unionByName(after.select(*keys, *events, *nothing, F.lit(True).alias("_end")))
    sums = _sums(frames)
    if ewms:
        both = lagged_ewm(both, keys, ewms, EVENT, sizes)
    seen = list(dict.fromkeys(e.source for e in ewms))
    both = row_numbers(both, keys, [F.col(c) for c in EVENT], "_seq", sizes).withColumns({f"_at_{s}": F.when(F.col(s).isNotNull(), F.col("_seq")) for s in seen})
    wanted = [*sums, *[Frame(f"_last_{s}", "max", f"_at_{s}") for s in seen]]
    if wanted:
        both = lagged_frames(both, keys, wanted, EVENT, sizes)
    state = both.where("_end").select(
        *keys, *[F.col(f.out) for f in sums], *[F.col(e.out) for e in ewms], *[(F.col("_seq") - F.col(f"_last_{s}")).cast("long").alias(f"_gap_{s}") for s in seen]
    )
    return Part(tail, materialize(state, "snapshot-state"))


def resume(new: DataFrame, snapshot: Snapshot) -> DataFrame:
    """Add the lagged features to new rows, as if all history stood before them.

    New rows come after every row of the snapshot. For teams, ``new`` has team events.
    """
    keep = new.columns
    df = new
    finish: list[str] = []
    for scope, (lags, frames, ewms) in _by_scope(snapshot.lags, snapshot.team).items():
        keys = [snapshot.entity, *scope]
        part = snapshot.parts[scope]
        df = _resumed(df, keys, part, frames, ewms)
        finish += [ft._finish(lag, snapshot.team) for lag in lags]
    return df.selectExpr(*[f"`{c}`" for c in keep], *finish)


def _resumed(df: DataFrame, keys: list[str], part: Part, frames: Sequence[Frame], ewms: Sequence[Ewm]) -> DataFrame:
    columns = df.columns
    state = part.state.select(*keys, *[F.col(c).alias(f"_was_{c}") for c in part.state.columns if c not in keys])
    sizes = group_sizes(df, keys)
    out = df
    if ewms:
        out = _resumed_ewm(out.join(state, keys, "left"), keys, ewms, sizes).drop(*[c for c in state.columns if c not in keys])
    bounded, sums = _bounded(frames), _sums(frames)
    if bounded:
        rows = out.withColumn("_new", F.lit(True)).unionByName(part.tail.withColumn("_new", F.lit(False)), allowMissingColumns=True)
        # Tails of entities that do not race again take no part.
        rows = rows.join(df.select(*keys).distinct(), keys, "left_semi")
        reach = max(f.rows for f in bounded)
        out = lagged_frames(rows, keys, bounded, EVENT, (sizes[0] + reach, sizes[1])).where("_new").drop("_new")
    if sums:
        out = lagged_frames(out, keys, [Frame(f"_own_{f.out}", f.agg, f.source) for f in sums], EVENT, sizes).join(state.select(*keys, *[f"_was_{f.out}" for f in sums]), keys, "left")
        total = {f.out: F.when(F.col(f"_own_{f.out}").isNotNull() | F.col(f"_was_{f.out}").isNotNull(), F.coalesce(F.col(f"_own_{f.out}"), F.lit(0)) + F.coalesce(F.col(f"_was_{f.out}"), F.lit(0))) for f in sums}
        out = out.withColumns(total).drop(*[f"{p}{f.out}" for p in ("_own_", "_was_") for f in sums])
    return out.select(*columns, *[c for c in out.columns if c not in columns])


def _resumed_ewm(df: DataFrame, keys: list[str], ewms: Sequence[Ewm], sizes: tuple[int, int]) -> DataFrame:
    """The weighted means of ``timeline``, started from the snapshot's instead of nothing."""
    steepest = max(-math.log1p(-2.0 / (e.span + 1)) for e in ewms)
    if sizes[0] * steepest > LOG_DECAY_LIMIT:
        raise ValueError("too many new events at once for the spans: advance the snapshot in steps")
    past, now = window(keys, EVENT, PAST), window(keys, EVENT, UP_TO_NOW)
    metrics = list(dict.fromkeys(e.source for e in ewms))
    n = range(len(ewms))
    steps = [_step(f"_x_{e.source}", f"_g_{e.source}", 2.0 / (e.span + 1)) for e in ewms]
    out = (
        df.selectExpr("*", f"row_number() OVER {window(keys, EVENT)} AS _seq", *[f"CAST(`{m}` AS DOUBLE) AS `_x_{m}`" for m in metrics])
        .selectExpr("*", *[f"max(CASE WHEN `_x_{m}` IS NOT NULL THEN _seq END) OVER {past} AS `_last_{m}`" for m in metrics])
        # Before the first new value the gap reaches back into the history.
        .selectExpr("*", *[f"CAST(coalesce(_seq - `_last_{m}`, _seq - 1 + `_was__gap_{m}`) AS DOUBLE) AS `_g_{m}`" for m in metrics])
        .selectExpr("*", *[f"{d} AS _d{i}" for i, (d, _) in enumerate(steps)], *[f"{v} AS _b{i}" for i, (_, v) in enumerate(steps)])
        .selectExpr("*", *[f"sum(_d{i}) OVER {now} AS _l{i}" for i in n])
        .selectExpr("*", *[f"_b{i} * exp(-_l{i}) AS _t{i}" for i in n])
    )
    means = [
        f"CASE WHEN `_last_{e.source}` IS NOT NULL OR `_was_{e.out}` IS NOT NULL THEN exp(coalesce(sum(_d{i}) OVER {past}, 0D)) * (coalesce(`_was_{e.out}`, 0D) + coalesce(sum(_t{i}) OVER {past}, 0D)) END AS `{e.out}`"
        for i, e in enumerate(ewms)
    ]
    return out.selectExpr(*[f"`{c}`" for c in df.columns], *means)


def advance(snapshot: Snapshot, new: DataFrame) -> Snapshot:
    """The snapshot after the new rows, from the old one and these rows alone; for teams ``new`` has team events."""
    parts = {}
    for scope, (_, frames, ewms) in _by_scope(snapshot.lags, snapshot.team).items():
        keys = [snapshot.entity, *scope]
        old = snapshot.parts[scope]
        rows = materialize(_pruned(new, keys, frames, ewms), "snapshot-new")
        reach = max([f.rows for f in _bounded(frames)], default=0)
        joined = row_numbers(old.tail.unionByName(rows), keys, [F.col(c).desc() for c in EVENT], "_back")
        tail = materialize(joined.where(F.col("_back") <= reach).drop("_back"), "snapshot-tail")
        # Only entities of the new rows change; a row behind their last one gives their new state.
        nothing = [F.lit(None).cast(t).alias(c) for c, t in rows.dtypes if c not in (*keys, *EVENT)]
        later = rows.agg(F.max("Year")).scalar() + 1
        events = [*([] if "Year" in keys else [later.cast(rows.schema["Year"].dataType).alias("Year")]), F.lit(1_000_000).cast(rows.schema["Race_Num"].dataType).alias("Race_Num")]
        both = rows.withColumn("_end", F.lit(False)).unionByName(rows.select(*keys).distinct().select(*keys, *events, *nothing, F.lit(True).alias("_end")))
        seen = list(dict.fromkeys(e.source for e in ewms))
        done = _resumed(both, keys, old, _sums(frames), ewms)
        done = row_numbers(done, keys, [F.col(c) for c in EVENT], "_seq").withColumns({f"_at_{s}": F.when(F.col(s).isNotNull(), F.col("_seq")) for s in seen})
        if seen:
            done = lagged_frames(done, keys, [Frame(f"_last_{s}", "max", f"_at_{s}") for s in seen], EVENT)
        done = done.where("_end").join(old.state.select(*keys, *[F.col(f"_gap_{s}").alias(f"_was_gap_{s}") for s in seen]), keys, "left")
        state = done.select(
            *keys, *[F.col(f.out) for f in _sums(frames)], *[F.col(e.out) for e in ewms],
            *[F.coalesce(F.col("_seq") - F.col(f"_last_{s}"), F.col("_seq") - 1 + F.col(f"_was_gap_{s}")).cast("long").alias(f"_gap_{s}") for s in seen],
        )
        kept = old.state.join(rows.select(*keys).distinct(), keys, "left_anti").select(state.columns)
        parts[scope] = Part(tail, materialize(kept.unionByName(state), "snapshot-state"))
    return Snapshot(snapshot.entity, snapshot.lags, parts)
