"""Model frames, time split, weights, scoring and regression metrics
(PRJ-3, PRJ-5, PRJ-10, ML-2, AGG-5, TOP-3, AGG-8)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamp, nan_to_null
from ..operators.rank import global_row_number

# Reference split bounds (fixed values); the driver data uses its own bounds.
REFERENCE_SPLIT = ("2025-07-01", "2025-12-31", "2026-01-01")


def prepare_model_frame(df: DataFrame, feature_columns: Sequence[str], target: str = "future_ret_5d") -> DataFrame:
    """PRJ-3: drop rows missing ticker/date/close/target; features NULL/NaN/inf -> 0.0;
    features absent from ``df`` are added as 0.0."""
    out = df.dropna(subset=["ticker", "date", "close", target])
    cols = []
    for c in feature_columns:
        if c in df.columns:
            cols.append(F.coalesce(nan_to_null(F.col(c).cast("double")), F.lit(0.0)).alias(c))
        else:
            cols.append(F.lit(0.0).alias(c))
    others = [c for c in out.columns if c not in set(feature_columns)]
    return out.select(*others, *cols)


def split_column(date: Column, bounds: Sequence[str] = REFERENCE_SPLIT) -> Column:
    """PRJ-5: 'train' < validation start <= 'validation' <= validation end; 'test' >= test start."""
    v_start, v_end, t_start = (F.lit(b).cast("date") for b in bounds)
    return (
        F.when(date < v_start, F.lit("train"))
        .when((date >= v_start) & (date <= v_end), F.lit("validation"))
        .when(date >= t_start, F.lit("test"))
    )


def recency_weight(df: DataFrame, half_life_days: int = 180, date_col: str = "date") -> Column:
    """PRJ-10: clip(0.5 ** (age / half_life), 0.2, 1), age from the frame's max date.

    The max date is a scalar subquery (one aggregate over ``df``), not a
    window without partitioning.
    """
    max_date = df.select(F.max(date_col)).scalar()
    age = F.greatest(F.datediff(max_date, F.col(date_col)), F.lit(0)).cast("double")
    w = F.pow(F.lit(0.5), age / F.lit(float(max(half_life_days, 1))))
    return clamp(w, 0.2, 1.0)


def linear_score(coefs: Mapping[str, float], intercept: float = 0.0) -> Column:
    """ML-2 stand-in: ``intercept + sum(coef * coalesce(feature, 0))`` as one expression."""
    out = F.lit(float(intercept))
    for c, w in coefs.items():
        out = out + F.lit(float(w)) * F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return out


def regression_metrics(
    scored: DataFrame, groups: Sequence[str], y: str = "future_ret_5d", p: str = "prediction",
    tiebreak: Sequence[str] = ("ticker", "date"),
) -> DataFrame:
    """AGG-5 + TOP-3 per group: n, mae, rmse, r2, direction accuracy and the mean
    label of the bottom / top decile of predictions (k = max(1, floor(0.1 n))).

    Deciles use an exact distributed rank (no group is pulled into one task).
    """
    groups = list(groups)
    order = [(p, True), *[(c, True) for c in tiebreak]]
    ranked = global_row_number(scored.select(*groups, y, p, *tiebreak), groups, order, out="_rk")
    err = F.col(y) - F.col(p)
    base = ranked.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.sum(err * err).alias("_sse"),
        F.var_pop(F.col(y)).alias("_vy"),
        F.avg((F.signum(F.col(y)) == F.signum(F.col(p))).cast("double")).alias("direction_accuracy"),
    )
    k = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(0.1))).cast("long")
    dec = (
        ranked.join(base.select(*groups, "n"), on=groups)
        .withColumn("_k", k)
        .groupBy(*groups)
        .agg(
            F.avg(F.when(F.col("_rk") <= F.col("_k"), F.col(y))).alias("bottom_decile_avg_forward_return"),
            F.avg(F.when(F.col("_rk") > F.col("n") - F.col("_k"), F.col(y))).alias("top_decile_avg_forward_return"),
        )
    )
    sst = F.col("n") * F.col("_vy")
    r2 = F.when(sst > 0, F.lit(1.0) - F.col("_sse") / sst).when(F.col("_sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return base.join(dec, on=groups).select(
        *groups, "n", "mae", "rmse", r2.alias("r2"), "direction_accuracy",
        "top_decile_avg_forward_return", "bottom_decile_avg_forward_return",
    )


def training_window(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """AGG-8: first/last date and row count (per group)."""
    return df.groupBy(*groups).agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count(F.lit(1)).alias("rows")
    )


def as_date(value: str | dt.date) -> Column:
    return F.lit(str(value)).cast("date")
