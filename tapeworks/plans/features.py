"""DS-1: the daily feature panel (WIN-1..6, MATH-2/3, PRJ-13, JOIN-1).

All per-ticker windows share one ``partitionBy(ticker).orderBy(date)`` spec,
so the panel costs one shuffle on ``ticker`` plus one sort; the two Window
operators (volatility needs ``ret_1d`` first) reuse that order. A ticker holds
at most one bar per calendar day, so no window partition can outgrow the
calendar, however skewed the raw trades behind the bars are.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import rapid_move_flag, ratio, rel, return_bucket
from ..operators.windows import panel_window, rolling_max, rolling_mean, rolling_min, rolling_std

# Window lengths and horizons (fixed values).
RETURN_WINDOWS = [1, 3, 5, 10, 20, 60]
VOLATILITY_WINDOWS = [5, 20, 60]
MA_WINDOWS = [10, 20, 50, 200]
LABEL_HORIZONS = [1, 5, 10, 20]
CONTEXT_RETURNS = ["ret_1d", "ret_5d", "ret_20d"]

DEFAULT_ROLES = {"qqq": "QQQ", "spy": "SPY"}


def group_features(ohlcv: DataFrame) -> DataFrame:
    """Per-ticker returns, volatility, volume, moving-average, range and label columns."""
    w = panel_window()
    close = F.col("close")
    first = [
        *[rel(close, F.lag(close, n).over(w)).alias(f"ret_{n}d") for n in RETURN_WINDOWS],
        rolling_mean("volume", w, 20).alias("volume_ma20"),
        rolling_std("volume", w, 20).alias("volume_std20"),
        *[rolling_mean(close, w, n).alias(f"ma{n}") for n in MA_WINDOWS],
        ratio(F.col("high") - F.col("low"), close).alias("high_low_range"),
        rel(close, "open").alias("close_open_return"),
        rolling_max("high", w, 20).alias("rolling_high_20"),
        rolling_min("low", w, 20).alias("rolling_low_20"),
        *[F.lead(close, h).over(w).alias(f"future_close_{h}d") for h in LABEL_HORIZONS],
    ]
    step1 = ohlcv.select("*", *first)
    vol = [rolling_std("ret_1d", w, n).alias(f"volatility_{n}d") for n in VOLATILITY_WINDOWS]
    step2 = step1.select("*", *vol)
    derived = [
        F.coalesce(
            ratio(F.col("volume") - F.col("volume_ma20"), F.nullif(F.col("volume_std20"), F.lit(0.0))), F.lit(0.0)
        ).alias("volume_z20"),
        F.coalesce(ratio("volume", F.nullif(F.col("volume_ma20"), F.lit(0.0))), F.lit(0.0)).alias("volume_ratio_20"),
        *[rel(close, f"ma{n}").alias(f"close_vs_ma{n}") for n in MA_WINDOWS],
        rel(close, "rolling_high_20").alias("close_vs_20d_high"),
        rel(close, "rolling_low_20").alias("close_vs_20d_low"),
        rapid_move_flag("ret_1d", "volatility_20d").alias("rapid_move"),
        *[rel(f"future_close_{h}d", close).alias(f"future_ret_{h}d") for h in LABEL_HORIZONS],
    ]
    step3 = step2.select("*", *derived)
    return step3.withColumn("future_ret_5d_bucket", return_bucket("future_ret_5d"))


def benchmark_returns(ohlcv: DataFrame, roles: Mapping[str, str] = DEFAULT_ROLES) -> DataFrame:
    """One row per date with ``<role>_ret_{1,5,20}d`` of each benchmark ticker.

    The ticker filter sits on the window's partition key, so Catalyst pushes
    it below the window into the scan: only benchmark bars are read.
    """
    w = panel_window()
    close = F.col("close")
    lags = {"ret_1d": 1, "ret_5d": 5, "ret_20d": 20}
    bench = ohlcv.filter(F.col("ticker").isin(list(roles.values()))).select(
        "ticker", "date", *[rel(close, F.lag(close, n).over(w)).alias(name) for name, n in lags.items()]
    )
    aggs = [
        F.max(F.when(F.col("ticker") == sym, F.col(r))).alias(f"{role}_{r}")
        for role, sym in roles.items()
        for r in CONTEXT_RETURNS
    ]
    return bench.groupBy("date").agg(*aggs)


def add_market_context(panel: DataFrame, bench: DataFrame, roles: Mapping[str, str] = DEFAULT_ROLES) -> DataFrame:
    """JOIN-1: left join benchmark returns on date; relative 5-day strength."""
    out = panel.join(bench, on="date", how="left")
    return out.select(
        "*", *[(F.col("ret_5d") - F.col(f"{role}_ret_5d")).alias(f"stock_minus_{role}_ret_5d") for role in roles]
    )


def build_features(ohlcv: DataFrame, roles: Mapping[str, str] = DEFAULT_ROLES) -> DataFrame:
    """DS-1: full feature panel keyed (ticker, date)."""
    bars = ohlcv.select("ticker", "date", "open", "high", "low", "close", "volume")
    return add_market_context(group_features(bars), benchmark_returns(bars, roles), roles)
