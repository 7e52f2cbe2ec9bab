"""Column expressions. All of them stay inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Event-name suffix, classified statuses and the points scale.
EVENT_SUFFIX = " Grand Prix"
FINISHED_STATUSES = ("Finished", "+1 Lap", "+2 Laps", "+3 Laps", "+4 Laps", "+5 Laps")
POINTS_BY_POSITION = (25, 18, 15, 12, 10, 8, 6, 4, 2, 1)

# Abramowitz and Stegun 7.1.26, |error| <= 1.5e-7.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)

_DAY_CLOCK = r"^\s*(?:(\d+) days? )?(\d{1,2}):(\d{1,2}):(\d{1,2}(?:\.\d+)?)\s*$"
_MINUTE_CLOCK = r"^\s*([0-9.]+):([0-9.]+)\s*$"


def with_suffix(c: Column, suffix: str = EVENT_SUFFIX) -> Column:
    """Append the suffix to non-null names that lack it."""
    return F.when(c.isNotNull() & ~c.endswith(suffix), F.concat(c, F.lit(suffix))).otherwise(c)


def without_suffix(c: Column, suffix: str = EVENT_SUFFIX) -> Column:
    return F.when(c.endswith(suffix), F.substring(c, F.lit(1), F.length(c) - len(suffix))).otherwise(c)


def contains_flag(c: Column, needle: str) -> Column:
    """1 when the lower-cased text holds ``needle``; null counts as 0."""
    return F.coalesce(F.lower(c).contains(needle).cast("int"), F.lit(0))


def dnf_flag(status: Column, finished: Sequence[str] = FINISHED_STATUSES) -> Column:
    """1 unless the status is a classified finish; a missing status counts as not finished."""
    return (~F.coalesce(status.isin(*finished), F.lit(False))).cast("int")


def day_clock_seconds(c: Column) -> Column:
    """``N days HH:MM:SS.f`` or ``HH:MM:SS.f`` as seconds, else null."""

    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(c, _DAY_CLOCK, i), F.lit("")).try_cast("double")

    days = F.coalesce(part(1), F.lit(0.0))
    return days * 86400.0 + part(2) * 3600.0 + part(3) * 60.0 + part(4)


def minute_clock_seconds(c: Column) -> Column:
    """``m:ss.fff`` or plain seconds as double, else null."""
    minutes = F.nullif(F.regexp_extract(c, _MINUTE_CLOCK, 1), F.lit("")).try_cast("double")
    seconds = F.nullif(F.regexp_extract(c, _MINUTE_CLOCK, 2), F.lit("")).try_cast("double")
    return F.when(c.contains(":"), minutes * 60.0 + seconds).otherwise(F.trim(c).try_cast("double"))


def utc_naive(c: Column, zone: str) -> Column:
    """Wall-clock time in ``zone`` as a zone-less UTC timestamp.

    ``convert_timezone`` works on zone-less timestamps, so the session zone has no say.
    """
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), c.cast("timestamp_ntz"))


def clamp(c: Column, low: float, high: float) -> Column:
    """Limit to [low, high]; null stays null (``greatest`` alone would drop it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * x)
    poly = F.lit(ERF_A[4])
    for a in reversed(ERF_A[:4]):
        poly = poly * t + F.lit(a)
    erf = F.lit(1.0) - poly * t * F.exp(-x * x)
    return F.when(z >= 0, (F.lit(1.0) + erf) / 2.0).otherwise((F.lit(1.0) - erf) / 2.0)


def prob_at_most(k: float, mu: Column, sigma: Column) -> Column:
    """Probability of finishing in the first ``k``, with continuity correction."""
    return normal_cdf((F.lit(float(k)) + 0.5 - mu) / F.greatest(sigma, F.lit(1e-6)))


def points_for(position: Column, scale: Sequence[float] = POINTS_BY_POSITION) -> Column:
    table = F.array(*[F.lit(float(p)) for p in scale])
    ok = (position >= 1) & (position <= len(scale))
    return F.when(ok, F.element_at(table, position.cast("int"))).otherwise(F.lit(0.0))


def relevance(position: Column) -> Column:
    return F.lit(1.0) / F.greatest(F.lit(1.0), position)


def row_digest(cols: Sequence[str]) -> Column:
    """md5 of a row's values as text; nulls and empty strings differ."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in cols]))


def digest_number(digest: Column) -> Column:
    """The first 60 bits of an md5 text as a number that sums without overflow."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(20,0)")
