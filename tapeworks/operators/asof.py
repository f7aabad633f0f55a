"""Point-in-time joins at day granularity (JOIN-4..8).

Spark has no as-of join in the DataFrame API. Instead of a range join (a
nested loop) or one big window per key (a hot ticker would land in one task),
each operator turns the range condition into an **equi-join on
(key, day)**:

* ``asof_backward``: every right row is spread over the days it is the latest
  row for, ``[date, next_date)``; the last row of a key is spread up to the
  last left day of that key. Right rows are one per (key, date), so the
  spread is bounded by the calendar, and each left row finds at most one
  partner. The join itself is a plain shuffle join, so AQE's skew handling
  splits a hot (key, day) on the left side.
* ``asof_forward``: the mirror image, spread over ``(prev_date, date]``,
  cut to the tolerance when one is given.
* ``trailing_top_n``: for each anchor (key, day) the ``n`` newest rows with
  day in ``[day - lookback, day]``. Each source day is first cut to its
  ``n`` newest rows (a ``row_number <= n`` filter that Spark runs as a
  partial WindowGroupLimit before the shuffle), then spread over the
  ``lookback + 1`` anchor days it can serve. Work and shuffle stay
  ``O(rows x (lookback + 1))`` however hot a key is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _day(c: str | Column) -> Column:
    return F.to_date(F.col(c) if isinstance(c, str) else c)


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_day: str | Column,
    right_day: str,
    right_cols: Sequence[str],
    max_staleness_days: int | None = None,
) -> DataFrame:
    """Left join each left row to the right row of the same key with the greatest
    ``right_day <= left_day`` (an ``ASOF LEFT JOIN`` at day granularity).

    ``right`` must hold at most one row per (key, day). Right columns that are
    absent for a left row come back NULL. ``max_staleness_days`` optionally
    rejects partners older than that many days.
    """
    by = list(by)
    lday = "_asof_day"
    lft = left.withColumn(lday, _day(left_day))
    last_left = lft.groupBy(*by).agg(F.max(lday).alias("_last_left"))
    w = Window.partitionBy(*by).orderBy("_rday")
    r = right.select(*by, F.col(right_day).alias("_rday"), *right_cols)
    r = r.withColumn("_next", F.lead("_rday").over(w))
    # the last right row of a key reaches the last left day of that key
    r = r.join(last_left, on=by, how="left")
    end = F.coalesce(
        F.date_sub(F.col("_next"), 1),
        F.greatest(F.col("_rday"), F.coalesce(F.col("_last_left"), F.col("_rday"))),
    )
    if max_staleness_days is not None:
        end = F.least(end, F.date_add(F.col("_rday"), int(max_staleness_days)))
    spread = r.select(
        *by, F.explode(F.sequence(F.col("_rday"), end)).alias(lday), F.col("_rday"), *right_cols
    )
    return lft.join(spread, on=[*by, lday], how="left").drop(lday, "_rday")


def latest_before(left: DataFrame, right: DataFrame, by: Sequence[str], left_day: str, right_day: str, right_cols: Sequence[str]) -> DataFrame:
    """``asof_backward`` for a left side with one row per key: no window and no
    spread, one partial aggregate over the right rows up to the key's day."""
    by = list(by)
    r = right.select(*by, F.col(right_day).alias("_rday"), F.struct(*right_cols).alias("_r"))
    upto = r.join(left.select(*by, F.col(left_day).alias("_lday")), on=by).filter(F.col("_rday") <= F.col("_lday"))
    last = upto.groupBy(*by).agg(F.max_by("_r", "_rday").alias("_r"))
    return left.join(last, on=by, how="left").select(*left.columns, *[F.col("_r")[c].alias(c) for c in right_cols])


def asof_forward(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_day: str | Column,
    right_day: str,
    right_cols: Sequence[str],
    tolerance_days: int | None = None,
    matched_day_col: str | None = None,
) -> DataFrame:
    """Left join each left row to the right row with the smallest
    ``right_day >= left_day`` and, with a tolerance, ``right_day < left_day + tolerance``.
    """
    by = list(by)
    lday = "_asof_day"
    lft = left.withColumn(lday, _day(left_day))
    w = Window.partitionBy(*by).orderBy("_rday")
    r = right.select(*by, F.col(right_day).alias("_rday"), *right_cols)
    r = r.withColumn("_prev", F.lag("_rday").over(w))
    if tolerance_days is not None:
        start = F.date_sub(F.col("_rday"), int(tolerance_days) - 1)
        start = F.when(F.col("_prev").isNull(), start).otherwise(F.greatest(start, F.date_add(F.col("_prev"), 1)))
    else:
        first_left = lft.groupBy(*by).agg(F.min(lday).alias("_first_left"))
        r = r.join(first_left, on=by, how="left")
        start = F.coalesce(
            F.date_add(F.col("_prev"), 1),
            F.least(F.col("_rday"), F.coalesce(F.col("_first_left"), F.col("_rday"))),
        )
    spread = r.select(*by, F.explode(F.sequence(start, F.col("_rday"))).alias(lday), F.col("_rday"), *right_cols)
    out = lft.join(spread, on=[*by, lday], how="left").drop(lday)
    if matched_day_col:
        return out.withColumnRenamed("_rday", matched_day_col)
    return out.drop("_rday")


def _sort_key(order: Sequence[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).asc() if asc else F.col(c).desc() for c, asc in order]


def trailing_top_n(
    anchors: DataFrame,
    items: DataFrame,
    by: Sequence[str],
    anchor_day: str,
    item_day: str,
    order: Sequence[tuple[str, bool]],
    payload: Sequence[str],
    n: int,
    lookback_days: int,
    out_col: str = "items",
) -> DataFrame:
    """For each anchor row, an array of the ``n`` first ``items`` (by ``order``)
    of the same key whose day lies in ``[anchor_day - lookback_days, anchor_day]``.

    ``order`` is a list of ``(column, ascending)`` and must be a total order
    (end it with a unique column); ``payload`` names the item columns kept in
    the array, in order. Anchors without items get an empty array, and the
    array is sorted by ``order``.
    """
    by = list(by)
    keep = list(dict.fromkeys([*by, item_day, *[c for c, _ in order], *payload]))
    per_day = (
        items.select(*keep)
        .withColumn("_r", F.row_number().over(Window.partitionBy(*by, item_day).orderBy(*_sort_key(order))))
        .filter(F.col("_r") <= n)
        .drop("_r")
    )
    spread = per_day.withColumn(
        "_aday", F.explode(F.sequence(F.col(item_day), F.date_add(F.col(item_day), int(lookback_days))))
    )
    keys = anchors.select(*by, F.col(anchor_day).alias("_aday")).distinct()
    cand = spread.join(keys, on=[*by, "_aday"], how="left_semi")
    top = cand.withColumn(
        "_r", F.row_number().over(Window.partitionBy(*by, "_aday").orderBy(*_sort_key(order)))
    ).filter(F.col("_r") <= n)
    packed = top.groupBy(*by, "_aday").agg(
        F.array_sort(F.collect_list(F.struct("_r", *payload))).alias("_items")
    )
    packed = packed.select(*by, "_aday", F.transform("_items", lambda s: s.dropFields("_r")).alias(out_col))
    item_type = packed.schema[out_col].dataType
    joined = (
        anchors.withColumn("_aday", F.col(anchor_day))
        .join(packed, on=[*by, "_aday"], how="left")
        .drop("_aday")
    )
    return joined.withColumn(out_col, F.coalesce(F.col(out_col), F.array().cast(item_type)))
