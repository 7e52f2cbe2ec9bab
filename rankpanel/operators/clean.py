"""Cleansing, lookups, roster and union operators."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankpanel.functions.columns import contains_flag, with_suffix, without_suffix

HOURLY_SCHEMA = "hourly array<struct<temp:double,humidity:double,pressure:double,wind_speed:double,pop:double>>"


def coerce(df: DataFrame, numbers: Sequence[str] = (), dates: Sequence[str] = (), date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Lenient typing: values that do not parse become null."""
    new = {c: F.col(c).try_cast("double") for c in numbers if c in df.columns}
    new |= {c: F.try_to_timestamp(c, F.lit(date_format)).cast("date") for c in dates if c in df.columns}
    return df.withColumns(new) if new else df


def canonical_names(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Replace ``column`` by its alias where one exists; ``aliases`` is (name, alias)."""
    lookup = aliases.select(F.col("name").alias(column), F.col("alias").alias("_alias"))
    joined = df.join(lookup, column, "left")
    return joined.withColumn(column, F.coalesce("_alias", column)).select(df.columns)


def event_by_name(schedule: DataFrame, name: str) -> DataFrame:
    """First round with that name."""
    return schedule.where(F.col("EventName") == name).orderBy("Year", "RoundNumber").limit(1)


def lookup_with_suffix(df: DataFrame, key: str, dimension: DataFrame, values: Sequence[str]) -> DataFrame:
    """Attach dimension values by name, else by the name with or without the suffix."""
    other = F.when(F.col(key).endswith(" Grand Prix"), without_suffix(F.col(key))).otherwise(with_suffix(F.col(key)))
    exact = dimension.select(F.col(key), F.lit(True).alias("_hit"), *[F.col(v).alias(f"_a_{v}") for v in values])
    near = dimension.select(F.col(key).alias("_other"), *[F.col(v).alias(f"_b_{v}") for v in values])
    joined = df.withColumn("_other", other).join(exact, key, "left").join(near, "_other", "left")
    return joined.select(
        *df.columns, *[F.when(F.col("_hit"), F.col(f"_a_{v}")).otherwise(F.col(f"_b_{v}")).alias(v) for v in values]
    )


def ensure_columns(df: DataFrame, columns: dict[str, str], rename: dict[str, str] | None = None) -> DataFrame:
    """Rename columns that exist, then add missing ones as typed nulls."""
    df = df.withColumnsRenamed(rename or {})
    missing = {c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def left_join_coalescing(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join; columns on both sides keep the left value and fall back to the right."""
    clash = [c for c in right.columns if c in left.columns and c not in keys]
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in clash})
    joined = left.join(renamed, list(keys), "left")
    cols = [F.coalesce(F.col(c), F.col(f"_r_{c}")).alias(c) if c in clash else F.col(c) for c in left.columns]
    extra = [c for c in right.columns if c not in left.columns]
    return joined.select(*cols, *extra)


def allow_list(df: DataFrame, allowed: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Only allowed columns, in the frame's order; an empty list allows all."""
    if not allowed:
        return df
    return df.select([c for c in df.columns if c in allowed or c in keep])


class ContractError(ValueError):
    """A required feature column is absent."""


def enforce_contract(
    df: DataFrame,
    features: Sequence[str],
    defaults: dict[str, float | None],
    critical: Sequence[str] | None = None,
    keep: Sequence[str] = (),
    strict: bool = True,
) -> DataFrame:
    """Exactly the contract's columns, numeric, complete, in contract order.

    In strict mode an absent critical column (any column, when none are named)
    is an error; otherwise it is created from its default.
    """
    absent = [c for c in features if c not in df.columns and (not critical or c in critical)]
    if strict and absent:
        raise ContractError(f"missing features: {absent}")

    def default(c: str) -> float:
        v = defaults.get(c)
        return float(v) if v is not None and math.isfinite(v) else 0.0

    cols = []
    for c in features:
        if c not in df.columns:
            cols.append(F.lit(default(c)).alias(c))
            continue
        number = F.col(c).try_cast("double")
        cols.append(F.coalesce(F.when(~F.isnan(number), number), F.lit(default(c))).alias(c))
    return df.select(*keep, *cols)


def contract_difference(required: DataFrame, available: DataFrame) -> DataFrame:
    """Feature names only one side has, with the side that lacks them."""
    missing = required.exceptAll(available).withColumn("kind", F.lit("missing"))
    return missing.unionByName(available.exceptAll(required).withColumn("kind", F.lit("extra")))


def labelled_numeric(df: DataFrame, target: str, keys: Sequence[str]) -> DataFrame:
    """Rows with a target; keys, target and the numeric columns."""
    numeric = ("int", "bigint", "smallint", "tinyint", "float", "double")
    cols = [c for c, t in df.dtypes if c not in keys and c != target and (t in numeric or t.startswith("decimal"))]
    return df.na.drop(subset=[target]).select(*keys, target, *cols)


def expand_roster(events: DataFrame, roster: DataFrame) -> DataFrame:
    """One row per roster entry of each event, with the sprint flag: an equi-join on the event."""
    named = events.select(
        "Year",
        F.col("RoundNumber").alias("Race_Num"),
        F.col("EventName").alias("Circuit"),
        F.col("EventDate").alias("Date"),
        contains_flag(F.col("EventFormat"), "sprint").alias("Is_Sprint"),
    )
    return roster.join(named, ["Year", "Race_Num"])


def next_event(schedule: DataFrame, as_of: Column) -> DataFrame:
    return schedule.where(F.col("EventDate") > as_of).orderBy("EventDate", "RoundNumber").limit(1)


def latest_completed_event(schedule: DataFrame, as_of: Column, up_to_round: int | None = None) -> DataFrame:
    done = schedule.where(F.col("EventDate") < as_of)
    if up_to_round is not None:
        done = done.where(F.col("RoundNumber") <= up_to_round)
    return done.orderBy(F.col("EventDate").desc(), F.col("RoundNumber").desc()).limit(1)


def source_event_for(targets: DataFrame, panel: DataFrame) -> DataFrame:
    """For each target event, the event whose roster applies.

    That is the season's latest event with rows at or before the round, else
    the latest event of an earlier season. Windows run per season, plus one
    over the seasons.
    """
    have = panel.select("Year", "Race_Num").distinct()
    marks = targets.select("Year", "Race_Num", F.lit(1).alias("_target"), F.lit(None).cast("int").alias("_have")).unionByName(
        have.select("Year", "Race_Num", F.lit(0).alias("_target"), F.col("Race_Num").cast("int").alias("_have"))
    )
    upto = Window.partitionBy("Year").orderBy("Race_Num").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = marks.select("*", F.max("_have").over(upto).alias("_round")).where(F.col("_target") == 1)
    seasons = marks.groupBy("Year").agg(F.max("_have").alias("_last"))
    earlier = Window.orderBy("Year").rowsBetween(Window.unboundedPreceding, -1)
    prior = seasons.select(
        "Year",
        F.max(F.when(F.col("_last").isNotNull(), F.struct(F.col("Year").alias("y"), F.col("_last").alias("r")))).over(earlier).alias("_prior"),
    )
    return (
        same.join(prior, "Year")
        .select(
            "Year",
            "Race_Num",
            F.when(F.col("_round").isNotNull(), F.col("Year")).otherwise(F.col("_prior.y")).alias("Source_Year"),
            F.coalesce(F.col("_round"), F.col("_prior.r")).alias("Source_Race_Num"),
        )
        .where(F.col("Source_Year").isNotNull())
    )


def as_of_roster(targets: DataFrame, panel: DataFrame, sequence: str | None = None) -> DataFrame:
    """(target event, Driver, Team): the last team of each driver at the source event.

    ``sequence`` orders a driver's rows within an event; without it the panel
    holds one row per driver and event.
    """
    source = source_event_for(targets, panel)
    order = F.struct(*([sequence] if sequence else []), "Team")
    entries = panel.groupBy("Year", "Race_Num", "Driver").agg(F.max_by("Team", order).alias("Team"))
    entries = entries.withColumnsRenamed({"Year": "Source_Year", "Race_Num": "Source_Race_Num"})
    return entries.join(source, ["Source_Year", "Source_Race_Num"]).select("Year", "Race_Num", "Driver", "Team")


def latest_round_of_year(df: DataFrame, year: int) -> DataFrame:
    """Rows of the year's last round."""
    season = df.where(F.col("Year") == year)
    return season.where(F.col("Race_Num") == season.agg(F.max("Race_Num")).scalar())


def union_widening(history: DataFrame, upcoming: DataFrame) -> DataFrame:
    """UNION ALL by name with an ``is_upcoming`` flag; absent columns are null."""
    return history.withColumn("is_upcoming", F.lit(False)).unionByName(
        upcoming.withColumn("is_upcoming", F.lit(True)), allowMissingColumns=True
    )


def upcoming_slice(engineered: DataFrame, target: str = "Position") -> DataFrame:
    return engineered.where("is_upcoming").drop("is_upcoming", target)


def forecast_means(payload: Column, hours: int) -> dict[str, Column]:
    """Means over the first ``hours`` entries of an hourly JSON forecast.

    Absent values are left out, except the rain probability, which counts as 0.
    """
    head = F.slice(F.from_json(payload, HOURLY_SCHEMA)["hourly"], 1, max(1, int(hours)))

    def mean(values: Column) -> Column:
        return F.when(
            F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)
        )

    def field(name: str) -> Column:
        return mean(F.filter(F.transform(head, lambda h: h[name]), lambda x: x.isNotNull()))

    rain = mean(F.transform(head, lambda h: F.coalesce(h["pop"], F.lit(0.0))))
    return {
        "AirTemp": field("temp"),
        "Humidity": field("humidity"),
        "Pressure": field("pressure"),
        "WindSpeed": field("wind_speed"),
        "Rainfall": F.lit(100.0) * rain,
    }


def attach_scalars(df: DataFrame, one_row: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add the values of a one-row frame to every row, as scalar subqueries."""
    return df.withColumns({c: one_row.select(c).scalar() for c in columns})


def rounds_from_spec(specs: DataFrame, spec: str = "spec") -> DataFrame:
    """Rounds named by texts like ``1,3,5-7``; bad parts are skipped, reversed ranges allowed."""
    part = F.trim(F.col("_part"))
    low = F.regexp_extract(part, r"^(\d+)", 1).try_cast("int")
    high = F.coalesce(F.nullif(F.regexp_extract(part, r"^\d+\s*-\s*(\d+)$", 1), F.lit("")).try_cast("int"), low)
    rest = [c for c in specs.columns if c != spec]
    return (
        specs.select(*rest, F.explode(F.split(spec, ",")).alias("_part"))
        .where(part.rlike(r"^\d+(\s*-\s*\d+)?$"))
        .select(*rest, F.explode(F.sequence(F.least(low, high), F.greatest(low, high))).alias("RoundNumber"))
        .distinct()
    )


def events_of_rounds(schedule: DataFrame, spec: str | None) -> DataFrame:
    """Schedule rows of the named rounds; None or ``all`` keeps every round."""
    if not spec or spec.strip().lower() == "all":
        return schedule
    one = schedule.sparkSession.createDataFrame([(spec,)], "spec string")
    return schedule.join(rounds_from_spec(one), "RoundNumber", "left_semi")


def top(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """Sort and head; plans to a per-partition top-n."""
    return df.orderBy(*order).limit(n)
