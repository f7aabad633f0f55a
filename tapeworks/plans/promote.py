"""DS-14 candidate evaluation, JOIN-14 side-by-side view, DS-15 promotion gate
and the SNK-7 model-run row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .backtest import run_weekly_backtest
from .evaluation import regression_metrics

METRIC_COLS = ["mae", "rmse", "r2", "direction_accuracy", "top_decile_avg_forward_return",
               "bottom_decile_avg_forward_return"]
BACKTEST_COLS = ["periods", "total_return", "benchmark_total_return", "sharpe_like", "max_drawdown"]


def evaluate_models(
    scored: DataFrame, roles: DataFrame, benchmark_ticker: str, excluded: Sequence[str], split: str = "validation"
) -> DataFrame:
    """DS-14 long form: one row per (role, model) with validation metrics and
    the full-period backtest summary. ``roles``: (role, model_name, model_version)."""
    s = scored.join(roles, ["model_name", "model_version"], "left_semi")
    keys = ["model_name", "model_version"]
    metrics = regression_metrics(s.filter(F.col("split") == split), keys)
    _, bt = run_weekly_backtest(s, benchmark_ticker, excluded)
    return roles.join(metrics, keys, "left").join(bt, keys, "left")


def side_by_side(evaluated: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """JOIN-14: one row (per ``keys``) with ``candidate_*`` and ``production_*`` columns,
    by conditional aggregation over the long table (no join)."""
    cols = ["model_name", "model_version", *METRIC_COLS, *BACKTEST_COLS]
    aggs = [
        F.max(F.when(F.col("role") == role, F.col(c))).alias(f"{role}_{c}")
        for role in ("candidate", "production")
        for c in cols
    ]
    return evaluated.groupBy(*keys).agg(*aggs)


def promotion_passed(c: str = "candidate_", p: str = "production_") -> Column:
    """DS-15 (R13); any NULL operand -> not passed."""
    rule = (
        (F.col(f"{c}direction_accuracy") >= F.col(f"{p}direction_accuracy"))
        & (F.col(f"{c}rmse") <= F.col(f"{p}rmse") * F.lit(1.02))
        & (F.col(f"{c}top_decile_avg_forward_return") > F.col(f"{p}top_decile_avg_forward_return"))
        & (F.col(f"{c}total_return") > F.col(f"{p}total_return"))
        & (F.col(f"{c}max_drawdown") <= F.col(f"{p}max_drawdown") * F.lit(1.10))
    )
    return F.coalesce(rule, F.lit(False))


def promotion_decision(side: DataFrame, model_type: str, created_at: Column) -> DataFrame:
    """DS-15 + SNK-7: the model-run row of the promotion check."""
    passed = promotion_passed()
    metrics = F.to_json(F.struct(*[F.col(c) for c in sorted(side.columns)]))
    return side.select(
        F.sha2(F.concat_ws("|", F.lit(model_type), F.col("candidate_model_version"), created_at.cast("string")), 256)
        .substr(1, 16).alias("run_id"),
        created_at.cast("timestamp").alias("created_at"),
        F.lit(model_type).alias("model_name"),
        F.col("candidate_model_version").alias("model_version"),
        F.lit("promotion_check").alias("run_type"),
        metrics.alias("metrics_json"),
        passed.cast("int").alias("promoted"),
        passed.alias("passed"),
    )
