"""Numeric expressions: safe ratios, clamps, label cuts (MATH-*, PRJ-2/12/13)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: str | Column, den: str | Column) -> Column:
    """``num / den`` with division by zero -> NULL (the reference's inf -> NaN)."""
    return F.try_divide(col_(num), col_(den))


def rel(num: str | Column, den: str | Column) -> Column:
    """``num / den - 1`` with zero denominators -> NULL."""
    return ratio(num, den) - F.lit(1.0)


def nan_to_null(c: str | Column) -> Column:
    """NaN and +-inf -> NULL; use at the edge of external data (PRJ-2)."""
    x = col_(c)
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(x)


def clamp(c: str | Column, lower: float, upper: float) -> Column:
    return F.greatest(F.lit(float(lower)), F.least(F.lit(float(upper)), col_(c)))


def sign(c: str | Column) -> Column:
    return F.signum(col_(c))


def confidence_label(score: str | Column) -> Column:
    """PRJ-12 cut points (fixed values: .75 high, .60 medium, .45 medium-low)."""
    s = col_(score)
    return (
        F.when(s.isNull(), F.lit(None).cast("string"))
        .when(s >= F.lit(0.75), F.lit("high"))
        .when(s >= F.lit(0.6), F.lit("medium"))
        .when(s >= F.lit(0.45), F.lit("medium-low"))
        .otherwise(F.lit("low"))
    )


def return_bucket(ret: str | Column) -> Column:
    """PRJ-13: right-closed bins at -5 %, -1 %, 1 %, 5 % -> 0..4 (double)."""
    r = col_(ret)
    return (
        F.when(r.isNull(), F.lit(None).cast("double"))
        .when(r <= F.lit(-0.05), F.lit(0.0))
        .when(r <= F.lit(-0.01), F.lit(1.0))
        .when(r <= F.lit(0.01), F.lit(2.0))
        .when(r <= F.lit(0.05), F.lit(3.0))
        .otherwise(F.lit(4.0))
    )


def rapid_move_flag(ret_1d: str | Column, vol_20d: str | Column, k: float = 2.5) -> Column:
    """MATH-3: abs(ret_1d) > k * volatility_20d as 0/1; missing -> 0."""
    return F.coalesce((F.abs(col_(ret_1d)) > F.lit(float(k)) * col_(vol_20d)).cast("int"), F.lit(0))
