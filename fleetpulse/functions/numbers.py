"""Scalar and aggregate expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ["ok", "low", "medium", "high"]


def nearest_rank(col: str, p: float) -> Column:
    """sorted[ceil(n * p) - 1], a value that occurs."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {col})").cast("bigint")


def int_div(a: Column, b: Column) -> Column:
    """Truncating division; null where the divisor is 0."""
    return F.when(b != 0, F.floor(F.abs(a) / F.abs(b)) * F.signum(a) * F.signum(b)).cast("bigint")


def share(part: Column, whole: Column, scale: float = 100.0) -> Column:
    """scale * part / whole, 0 where the whole is 0."""
    return F.when(whole > 0, part * F.lit(scale) / whole).otherwise(F.lit(0.0))


def percent_delta(before: Column, after: Column) -> Column:
    return F.when(before != 0, (after - before) * 100.0 / before).otherwise(F.lit(0.0))


def counter_delta(now: Column, before: Column) -> Column:
    """Growth of a cumulative counter; after a reset the new value is the growth."""
    return F.when(now >= before, now - before).otherwise(now)


def saturating_sum(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_add(a, b), F.lit(9223372036854775807))


def saturating_score(value: Column, pivot: float) -> Column:
    """min(8, 3 log1p(value) / log1p(pivot)), 0 for values up to 0."""
    return F.when(value > 0, F.least(F.lit(8.0), 3.0 * F.log1p(value) / F.log1p(F.lit(float(pivot))))).otherwise(F.lit(0.0))


def severity_rank(col: Column) -> Column:
    out = F.lit(0)
    for i, s in enumerate(SEVERITIES):
        out = F.when(col == s, F.lit(i)).otherwise(out)
    return out


def ladder(value: Column, high: float, medium: float, below: str = "ok") -> Column:
    return F.when(value >= high, "high").when(value >= medium, "medium").otherwise(below)
