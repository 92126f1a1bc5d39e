"""Numbers, dates and conditions whose meaning differs between engines; each says what it does with nulls and zeros."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_feature(c: Column) -> Column:
    """ln(1 + x), null as 0."""
    return F.log1p(F.coalesce(c, F.lit(0)))


def safe_divide(a: Column, b: Column) -> Column:
    """Null for a zero or null denominator."""
    return F.try_divide(a, F.when(b != 0, b))


def greatest_strict(*columns: Column) -> Column:
    """The greatest value, null if any is null."""
    known = columns[0].isNotNull()
    for c in columns[1:]:
        known = known & c.isNotNull()
    return F.when(known, F.greatest(*columns))


def z_score(x: Column, mean: Column, deviation: Column, constant: float) -> Column:
    """Standard score; `constant` where nothing deviates (zero or null deviation)."""
    sd = F.coalesce(deviation, F.lit(0.0))
    return F.when(sd == 0, F.lit(constant)).otherwise((x - mean) / sd)


def combined_score(share: Column, z: Column, weight: float = 0.8, cap: float = 5.0) -> Column:
    """weight * share, plus (1 - weight) * z / cap for positive z up to `cap`."""
    bonus = F.when(z > cap, 1.0).when(z > 0, z / cap).otherwise(0.0)
    return weight * share + (1 - weight) * bonus


def is_significant(z: Column, limit: float = 1.96) -> Column:
    return F.abs(z) > limit


def bins(c: Column, edges: Sequence[float]) -> Column:
    """The number of edges at or below the value: 0 below the first; null for null."""
    out = F.when(c.isNull(), F.lit(None).cast("int"))
    for k, e in enumerate(edges):
        out = out.when(c < e, F.lit(k))
    return out.otherwise(F.lit(len(edges)))


def months_between_calendar(a: Column, b: Column) -> Column:
    """Month boundaries from `b` to `a`: 31 January to 1 February is one."""
    return (F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b)


def within_days(date: Column, as_of: Column, days: int) -> Column:
    """In the `days` days that end with `as_of`."""
    return (date > F.date_sub(as_of, days)) & (date <= as_of)
