"""Ranking signals as Column expressions. Ages are taken at a given instant, never at the wall clock's."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(as_of: str) -> Column:
    return F.expr(f"TIMESTAMP_NTZ '{as_of}'")


def days_before(as_of: str, days: float) -> Column:
    return F.expr(f"TIMESTAMP_NTZ '{as_of}' - INTERVAL '1' SECOND * {int(days * 86400)}")


def age_days(time: Column, as_of: str) -> Column:
    """Days from a timestamp without zone to the instant; negative if it lies ahead."""
    micros = F.unix_micros(instant(as_of).cast("timestamp")) - F.unix_micros(time.cast("timestamp"))
    return micros / 86_400_000_000


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def recency(time: Column, as_of: str, half_life: float | None = None) -> Column:
    """1 for now, falling by half every ``half_life`` days or, without it, to 0 within a year."""
    age = F.greatest(F.lit(0.0), age_days(time, as_of))
    return F.exp(-age * math.log(2) / half_life) if half_life else clamp(1 - age / 365.0, 0.0, 1.0)


def usage_bonus(injected: Column) -> Column:
    """A bonus for records that were used before, so small that it can't feed on itself."""
    return F.least(F.lit(0.02), F.log1p(F.coalesce(injected, F.lit(0)).cast("double")) * 0.005)


def decayed_confidence(confidence: Column, step: float = 0.05, least: float = 0.15) -> Column:
    return F.greatest(F.lit(least), F.round(confidence - step, 4))
