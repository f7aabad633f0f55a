"""ML-3 walk-forward prior forecasts (WIN-11, WIN-12, JOIN-13, WIN-8).

Anchors are every ``step``-th bar after ``min_history`` bars of a ticker; each
anchor gets 1/5/20-step return forecasts, a 10 %/90 % band for 5 steps and a
confidence; non-anchor bars carry the last anchor's values forward and bars
before the first anchor are dropped.

The default forecaster is a drift model written as window expressions:
mean and sample std of the trailing ``lookback`` log returns give
``median_h = close * exp(mu h)`` and ``q = close * exp(mu h + z sigma sqrt(h))``.
It runs in the JVM with an oracle. Any other forecaster plugs in as a function
over batches of anchors, each with its own bounded history.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import bday_offset, roll_back_to_weekday
from ..functions.numeric import clamp
from ..schemas import PRIOR_FEATURE_COLUMNS

Z90 = 1.2815515655446004  # standard normal 90 % quantile (fixed value)


def business_day_regrid(history: DataFrame, order: str = "close") -> DataFrame:
    """WIN-11: keep the last row per (ticker, date), by the column ``order``, and re-stamp
    a ticker's n rows to the n business days ending at its last date (weekend end rolls back)."""
    others = [c for c in history.columns if c not in ("ticker", "date")]
    last_row = F.max_by(F.struct(*others), F.struct(order, *others)).alias("_r")
    dedup = history.groupBy("ticker", "date").agg(last_row).select("ticker", "date", "_r.*")
    w = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    last = F.first("date").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    k = F.row_number().over(w)
    return dedup.withColumn("timestamp", bday_offset(roll_back_to_weekday(last), -(k - 1)))


def drift_forecast(bars: DataFrame, min_history: int = 120, step: int = 5, lookback: int = 60) -> DataFrame:
    """ML-3 with the SQL drift forecaster: prior features keyed (ticker, date)."""
    w = Window.partitionBy("ticker").orderBy("date")
    base = bars.select("ticker", "date", "close").dropna()
    w_all = Window.partitionBy("ticker")
    x = base.select(
        "*",
        F.log(F.try_divide(F.col("close"), F.lag("close").over(w))).alias("_lr"),
        F.row_number().over(w).alias("_rn"),
        F.count(F.lit(1)).over(w_all).alias("_n"),
    )
    frame = w.rowsBetween(-(lookback - 1), Window.currentRow)
    x = x.select(
        "*",
        F.coalesce(F.avg("_lr").over(frame), F.lit(0.0)).alias("_mu"),
        F.coalesce(F.stddev_samp("_lr").over(frame), F.lit(0.0)).alias("_sd"),
    )
    anchor = (F.col("_n") >= min_history) & (F.col("_rn") >= min_history) & (
        ((F.col("_rn") - min_history) % step) == 0
    )
    mu, sd = F.col("_mu"), F.col("_sd")
    sqrt5 = F.sqrt(F.lit(5.0))
    lower = F.exp(mu * 5.0 - F.lit(Z90) * sd * sqrt5)
    upper = F.exp(mu * 5.0 + F.lit(Z90) * sd * sqrt5)
    cols = {
        "chronos_pred_ret_1d": F.exp(mu * 1.0) - 1.0,
        "chronos_pred_ret_5d": F.exp(mu * 5.0) - 1.0,
        "chronos_pred_ret_20d": F.exp(mu * 20.0) - 1.0,
        "chronos_bear_ret_5d": lower - 1.0,
        "chronos_bull_ret_5d": upper - 1.0,
        "chronos_confidence_score": F.greatest(F.lit(0.15), F.least(F.lit(0.95), F.lit(1.0) - F.abs(upper - lower))),
    }
    sampled = x.select("ticker", "date", "_n", *[F.when(anchor, c).alias(k) for k, c in cols.items()])
    return fill_forward_priors(sampled.filter(F.col("_n") >= min_history).drop("_n"))


def fill_forward_priors(sampled: DataFrame) -> DataFrame:
    """JOIN-13 + WIN-8: carry anchor forecasts forward; drop bars before the first one."""
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = sampled.select(
        "ticker", "date", *[F.last(c, ignorenulls=True).over(w).alias(c) for c in PRIOR_FEATURE_COLUMNS]
    )
    return filled.filter(F.col("chronos_pred_ret_5d").isNotNull())


Forecaster = Callable[[list[np.ndarray], int], np.ndarray]


def plugin_forecast(bars: DataFrame, forecaster: Forecaster, min_history: int = 120, step: int = 5, horizon: int = 20, context: int = 512) -> DataFrame:
    """ML-3 with another forecaster.

    Every anchor row carries its last ``context`` closes as an array column, so
    that anchors are independent rows: ``forecaster(histories, horizon)`` gets a
    batch of them and returns an array (anchors, 3, horizon) of median, 10 % and
    90 % prices. Returns and confidence are column expressions.
    """
    w = Window.partitionBy("ticker").orderBy("date")
    base = bars.select("ticker", "date", "close").dropna()
    number = F.row_number().over(w)
    kept = F.collect_list("close").over(w.rowsBetween(1 - context, Window.currentRow))
    rows = base.select("*", ((number >= min_history) & ((number - min_history) % step == 0)).alias("_anchor"), kept.alias("_history"))
    paths = ["_p1", "_p5", "_p20", "_low5", "_high5"]
    spots = [(0, 0), (0, min(5, horizon) - 1), (0, min(20, horizon) - 1), (1, min(5, horizon) - 1), (2, min(5, horizon) - 1)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            path = forecaster([np.asarray(x) for x in batch["_history"]], horizon) if len(batch) else np.zeros((0, 3, horizon))
            yield batch[["ticker", "date", "close"]].assign(**{c: path[:, k, h] for c, (k, h) in zip(paths, spots)})

    schema = "ticker string, date date, close double, " + ", ".join(f"{c} double" for c in paths)
    found = rows.filter("_anchor").select("ticker", "date", F.col("close").cast("double").alias("close"), "_history").mapInPandas(run, schema)
    ret = lambda c: F.try_divide(F.col(c), F.col("close")) - 1.0
    width = F.coalesce(F.abs(F.try_divide(F.col("_high5") - F.col("_low5"), F.col("close"))), F.lit(0.0))
    anchors = found.select(
        "ticker", "date",
        ret("_p1").alias("chronos_pred_ret_1d"), ret("_p5").alias("chronos_pred_ret_5d"), ret("_p20").alias("chronos_pred_ret_20d"),
        ret("_low5").alias("chronos_bear_ret_5d"), ret("_high5").alias("chronos_bull_ret_5d"),
        clamp(1.0 - width, 0.15, 0.95).alias("chronos_confidence_score"),
    )
    return fill_forward_priors(base.select("ticker", "date").join(anchors, ["ticker", "date"], "left"))
