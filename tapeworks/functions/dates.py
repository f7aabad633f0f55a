"""Date and time expressions (DT-*, PRJ-11, R6 business-day arithmetic)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_horizon(horizon: str) -> int:
    """``"5d"`` -> 5; anything not ending in ``d`` is an error (PRJ-11)."""
    cleaned = str(horizon).strip().lower()
    if not cleaned.endswith("d") or not re.fullmatch(r"-?\d+", cleaned[:-1]):
        raise ValueError(f"Unsupported horizon: {horizon}")
    return int(cleaned[:-1])


def roll_back_to_weekday(d: Column) -> Column:
    """Saturday/Sunday -> the Friday before; weekdays unchanged."""
    wd = F.weekday(d)  # Monday = 0
    return F.when(wd >= 5, F.date_sub(d, wd - 4)).otherwise(d)


def bday_offset(d: Column, n: int | Column) -> Column:
    """``d`` plus ``n`` business days (Mon-Fri, no holidays).

    Weekend starts roll back to Friday before counting, so Saturday + 1 is
    Monday. ``n = 0`` on a weekend rolls forward to Monday. Negative ``n``
    counts backwards (weekend start rolls forward to Monday first).
    """
    n_col = n if isinstance(n, Column) else F.lit(int(n))
    fwd_base = roll_back_to_weekday(d)
    wd_f = F.weekday(fwd_base)
    forward = F.date_add(fwd_base, (n_col + F.floor((wd_f + n_col) / 5) * 2).cast("int"))
    # backward: roll a weekend start forward to Monday, then step back
    wd = F.weekday(d)
    bwd_base = F.when(wd >= 5, F.date_add(d, 7 - wd)).otherwise(d)
    wd_b = F.weekday(bwd_base)
    m = -n_col
    backward = F.date_sub(bwd_base, (m + F.floor((4 - wd_b + m) / 5) * 2).cast("int"))
    zero = F.when(wd >= 5, F.date_add(d, 7 - wd)).otherwise(d)
    return F.when(n_col > 0, forward).when(n_col < 0, backward).otherwise(zero)


def bday_offset_sql(d: str, n: int) -> str:
    """DuckDB/ANSI text of :func:`bday_offset` for positive ``n`` (oracles)."""
    wd = f"(isodow({d}) - 1)"
    base = f"(case when {wd} >= 5 then {d} - cast({wd} - 4 as integer) else {d} end)"
    wdb = f"(isodow({base}) - 1)"
    return f"cast({base} + cast({n} + 2 * floor(({wdb} + {n}) / 5) as integer) as date)"


def utc_day(ts: Column) -> Column:
    """UTC midnight date of a timestamp (session time zone is UTC), DT-3."""
    return F.to_date(ts)


def days_back_bucket(days: Column) -> Column:
    """DT-4: request time-range bucket for a look-back in days."""
    return (
        F.when(days <= 1, F.lit("day"))
        .when(days <= 7, F.lit("week"))
        .when(days <= 31, F.lit("month"))
        .otherwise(F.lit("year"))
    )
