"""DS-11 outcome scoring and DS-12 scorecard (PRJ-6, JOIN-6, AGG-2..4, PRJ-9).

Outcomes are an append-only table keyed by ``prediction_id`` instead of an
in-place UPDATE; ``scored_predictions`` is ``predictions LEFT JOIN outcomes``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.asof import asof_forward

OUTCOME_COLUMNS = [
    "actual_close", "actual_return", "absolute_error", "return_error", "direction_correct",
    "within_prediction_range", "scored_at",
]


def matured(predictions: DataFrame, as_of: Column, outcomes: DataFrame | None = None) -> DataFrame:
    """PRJ-6: not yet scored and ``target_date < as_of``."""
    todo = predictions.filter(F.col("target_date") < as_of)
    if "actual_close" in predictions.columns:
        todo = todo.filter(F.col("actual_close").isNull())
    if outcomes is not None:
        todo = todo.join(outcomes.select("prediction_id"), "prediction_id", "left_anti")
    return todo


def score_outcomes(
    predictions: DataFrame, bars: DataFrame, as_of: Column, scored_at: Column,
    outcomes: DataFrame | None = None, tolerance_days: int = 7, carry: Sequence[str] = (),
) -> DataFrame:
    """DS-11 (R12): new outcome rows for matured predictions that have a bar, with the
    prediction's columns ``carry``, so that a report need not join them back."""
    read = ["prediction_id", "ticker", "target_date", "current_close", "predicted_close", "predicted_return", "bear_case", "bull_case"]
    todo = matured(predictions, as_of, outcomes).select(*dict.fromkeys([*read, *carry]))
    px = bars.select("ticker", "date", F.col("close").alias("actual_close"))
    hit = asof_forward(todo, px, ["ticker"], F.col("target_date"), "date", ["actual_close"], tolerance_days)
    hit = hit.filter(F.col("actual_close").isNotNull())
    actual_ret = F.try_divide(F.col("actual_close"), F.col("current_close")) - F.lit(1.0)
    out = hit.withColumn("actual_return", actual_ret)
    return out.select(
        "prediction_id",
        "actual_close",
        "actual_return",
        F.abs(F.col("actual_close") - F.col("predicted_close")).alias("absolute_error"),
        F.abs(F.col("actual_return") - F.col("predicted_return")).alias("return_error"),
        (F.signum("actual_return") == F.signum("predicted_return")).cast("int").alias("direction_correct"),
        ((F.col("bear_case") <= F.col("actual_close")) & (F.col("actual_close") <= F.col("bull_case")))
        .cast("int")
        .alias("within_prediction_range"),
        scored_at.cast("timestamp").alias("scored_at"),
        *[c for c in carry if c != "prediction_id"],
    )


def scored_predictions(predictions: DataFrame, outcomes: DataFrame) -> DataFrame:
    base = predictions.drop(*[c for c in OUTCOME_COLUMNS if c in predictions.columns])
    return base.join(outcomes, "prediction_id", "left")


def scorecard(scored: DataFrame) -> DataFrame:
    """DS-12: long report ``(section, key, metric, value)``.

    Rows are summed up once, by ticker and confidence bucket; that small table
    is then rolled up to the overall, per-ticker and per-bucket sections, so a
    row goes through one aggregate and not through three. Empty input gives an
    empty report.
    """
    s = scored.filter(F.col("actual_close").isNotNull() & F.col("actual_return").isNotNull())
    sq = (F.col("predicted_close") - F.col("actual_close")) * (F.col("predicted_close") - F.col("actual_close"))
    means = {
        "mae": F.col("absolute_error"), "mse": sq, "direction_accuracy": F.col("direction_correct").cast("double"),
        "range_coverage": F.col("within_prediction_range").cast("double"), "avg_predicted_return": F.col("predicted_return"),
        "avg_actual_return": F.col("actual_return"),
    }
    cells = s.groupBy("ticker", F.coalesce(F.col("confidence"), F.lit("unknown")).alias("confidence_bucket")).agg(
        F.count("prediction_id").alias("predictions"),
        *[x for m, c in means.items() for x in (F.sum(c).alias(f"_s_{m}"), F.count(c).alias(f"_n_{m}"))],
    )
    mean = lambda m: F.try_divide(F.sum(f"_s_{m}"), F.sum(f"_n_{m}"))
    agg = cells.groupingSets([[], ["ticker"], ["confidence_bucket"]], "ticker", "confidence_bucket").agg(
        F.grouping_id().alias("_gid"), F.sum("predictions").cast("double").alias("predictions"),
        *[(F.sqrt(mean(m)) if m == "mse" else mean(m)).alias("rmse" if m == "mse" else m) for m in means],
    )
    # grouping_id bits: ticker (2), confidence_bucket (1); 3 = overall
    gid = F.col("_gid")

    def lines(*metrics: str):
        return F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])

    overall = lines("mae", "rmse", "direction_accuracy", "range_coverage", "avg_predicted_return", "avg_actual_return")
    part = lines("predictions", "mae", "direction_accuracy", "avg_actual_return")
    return agg.select(
        F.when(gid == 3, "overall").when(gid == 1, "ticker").otherwise("confidence_bucket").alias("section"),
        F.when(gid == 1, F.col("ticker")).when(gid == 2, F.col("confidence_bucket")).alias("key"),
        F.inline(F.when(gid == 3, overall).otherwise(part)),
    ).filter((F.col("section") != "overall") | F.col("value").isNotNull())
