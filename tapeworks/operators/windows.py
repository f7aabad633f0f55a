"""Window operators over a (key, order) panel (WIN-*).

All frames are ROW frames like the reference's ``rolling(n)``. A rolling
statistic is reported only when its window holds ``n`` non-missing values
(pandas' ``min_periods = n``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def panel_window(keys: Sequence[str] = ("ticker",), order: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), Window.currentRow)


def full_window(agg: Column, x: Column, w: WindowSpec, n: int) -> Column:
    """``agg`` over the last ``n`` rows, NULL unless all ``n`` values are present."""
    frame = trailing(w, n)
    return F.when(F.count(x).over(frame) == n, agg.over(frame))


def rolling_mean(x: str | Column, w: WindowSpec, n: int) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return full_window(F.avg(c), c, w, n)


def rolling_std(x: str | Column, w: WindowSpec, n: int) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return full_window(F.stddev_samp(c), c, w, n)


def rolling_max(x: str | Column, w: WindowSpec, n: int) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return full_window(F.max(c), c, w, n)


def rolling_min(x: str | Column, w: WindowSpec, n: int) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return full_window(F.min(c), c, w, n)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: str, where: Column | None = None) -> DataFrame:
    """WIN-7: the row with the greatest ``order`` per key.

    ``max_by(struct(*), order)`` is a partial aggregate: each map task keeps
    one candidate per key before the shuffle, so a key with a third of all
    rows costs one row of shuffle, not a third of the table.
    """
    src = df if where is None else df.filter(where)
    others = [c for c in src.columns if c not in keys]
    packed = src.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(order)).alias("_row"))
    return packed.select(*keys, "_row.*")


def forward_fill(df: DataFrame, cols: Sequence[str], w: WindowSpec) -> DataFrame:
    """WIN-8: carry the last non-missing value forward within each key."""
    frame = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select(
        *[c for c in df.columns if c not in cols],
        *[F.last(c, ignorenulls=True).over(frame).alias(c) for c in cols],
    )


def strided_anchors(df: DataFrame, w: WindowSpec, min_history: int, step: int) -> DataFrame:
    """WIN-12: rows at positions min_history, min_history+step, ... (1-based)."""
    rn = F.row_number().over(w)
    return (
        df.withColumn("_rn", rn)
        .filter((F.col("_rn") >= min_history) & (((F.col("_rn") - min_history) % step) == 0))
        .drop("_rn")
    )
