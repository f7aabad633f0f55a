"""DS-13 weekly top-k backtest (AGG-7, TOP-1, JOIN-12, WIN-9, WIN-10, AGG-6).

Input is a *scored* panel (``prediction`` column from ML-2) with a
``model_name``/``model_version`` pair per row, so several models are tested
in one plan. Window partitions are (model, version): one row per week, bounded
by the calendar. The top-k per rebalance date is a ``row_number <= k`` filter
that Spark runs as a partial WindowGroupLimit before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MODEL_KEYS = ["model_name", "model_version"]


def rebalance_dates(panel: DataFrame, label: str = "future_ret_5d") -> DataFrame:
    """AGG-7: first trading date of each Monday-start week."""
    return panel.groupBy(F.date_trunc("week", F.col("date")).cast("date").alias("week")).agg(
        F.min("date").alias("date")
    )


def weekly_periods(
    scored: DataFrame,
    benchmark_ticker: str,
    excluded_tickers: Sequence[str],
    k: int = 5,
    slippage: float = 0.001,
    label: str = "future_ret_5d",
) -> DataFrame:
    """One row per (model, rebalance date): portfolio and benchmark return, picks."""
    bench = scored.filter(F.col("ticker") == benchmark_ticker).select(
        *MODEL_KEYS, "date", F.col(label).alias("_bench"), F.lit(True).alias("_has_bench")
    )
    working = scored.filter(~F.col("ticker").isin(list(excluded_tickers)) & F.col(label).isNotNull())
    rebal = rebalance_dates(working.select("date").distinct(), label).select("date")
    day = working.join(rebal, "date", "left_semi")
    w = Window.partitionBy(*MODEL_KEYS, "date").orderBy(F.col("prediction").desc(), F.col("ticker").asc())
    picks = day.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
    per = picks.groupBy(*MODEL_KEYS, "date").agg(
        (F.avg(label) - F.lit(float(slippage))).alias("portfolio_return"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_rn", "ticker"))), lambda s: s["ticker"]), ","
        ).alias("tickers"),
    )
    out = per.join(bench, on=[*MODEL_KEYS, "date"], how="left")
    return out.select(
        *MODEL_KEYS, "date", "portfolio_return",
        F.when(F.col("_has_bench"), F.col("_bench")).otherwise(F.lit(0.0)).alias("benchmark_return"),
        "tickers",
    )


def with_equity_curve(periods: DataFrame) -> DataFrame:
    """WIN-9/10: cumulative products, running peak (from the first period) and drawdown."""
    w = Window.partitionBy(*MODEL_KEYS).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = periods.select(
        "*",
        F.product(F.lit(1.0) + F.col("portfolio_return")).over(w).alias("cumulative"),
        F.product(F.lit(1.0) + F.col("benchmark_return")).over(w).alias("benchmark_cumulative"),
    )
    out = out.withColumn("running_peak", F.max("cumulative").over(w))
    return out.withColumn("drawdown", F.col("cumulative") / F.col("running_peak") - F.lit(1.0))


def summary(curve: DataFrame) -> DataFrame:
    """AGG-6: periods, total return, benchmark total return, sharpe-like, max drawdown."""
    sd = F.stddev_pop("portfolio_return")
    return curve.groupBy(*MODEL_KEYS).agg(
        F.count(F.lit(1)).alias("periods"),
        (F.max_by("cumulative", "date") - F.lit(1.0)).alias("total_return"),
        (F.max_by("benchmark_cumulative", "date") - F.lit(1.0)).alias("benchmark_total_return"),
        F.when(sd > 0, F.avg("portfolio_return") / sd * F.sqrt(F.lit(52.0))).otherwise(F.lit(0.0)).alias("sharpe_like"),
        F.abs(F.min("drawdown")).alias("max_drawdown"),
    )


def run_weekly_backtest(
    scored: DataFrame, benchmark_ticker: str, excluded_tickers: Sequence[str], k: int = 5, slippage: float = 0.001
) -> tuple[DataFrame, DataFrame]:
    """DS-13: (periods with equity curve, per-model summary)."""
    curve = with_equity_curve(weekly_periods(scored, benchmark_ticker, excluded_tickers, k, slippage))
    return curve, summary(curve)
