"""Table schemas and fixed column lists.

Fixed values: the feature-column names and their order below must equal the
reference's lists so that models and reports line up column by column.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values (feature column names, in the reference's order) ---------
PRICE_FEATURE_COLUMNS = [
    "ret_1d", "ret_3d", "ret_5d", "ret_10d", "ret_20d", "ret_60d",
    "volatility_5d", "volatility_20d", "volatility_60d",
    "volume_z20", "volume_ratio_20",
    "close_vs_ma10", "close_vs_ma20", "close_vs_ma50", "close_vs_ma200",
    "high_low_range", "close_open_return",
    "close_vs_20d_high", "close_vs_20d_low",
    "qqq_ret_1d", "qqq_ret_5d", "qqq_ret_20d",
    "spy_ret_1d", "spy_ret_5d", "spy_ret_20d",
    "stock_minus_qqq_ret_5d", "stock_minus_spy_ret_5d",
]

NEWS_FEATURE_COLUMNS = [
    "news_count",
    "avg_sentiment_stub", "max_positive_sentiment_stub", "max_negative_sentiment_stub",
    "earnings_count", "guidance_count", "ai_count", "lawsuit_count", "analyst_count", "regulatory_count",
    "company_specific_score", "macro_relevance_score", "novelty_score", "materiality_score",
    "event_confidence_score", "risk_flag_count",
]

PRIOR_FEATURE_COLUMNS = [
    "chronos_pred_ret_1d", "chronos_pred_ret_5d", "chronos_pred_ret_20d",
    "chronos_bear_ret_5d", "chronos_bull_ret_5d", "chronos_confidence_score",
]

# Benchmark symbols excluded from portfolios (fixed values).
BENCHMARK_TICKERS = ["QQQ", "SPY", "XLK", "SMH", "ARKK"]
# ---------------------------------------------------------------------------


def merged_feature_columns() -> list[str]:
    return PRICE_FEATURE_COLUMNS + PRIOR_FEATURE_COLUMNS + NEWS_FEATURE_COLUMNS


OHLCV = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.DoubleType()),
])

NEWS = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("published_at", T.TimestampType()),
    T.StructField("title", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("url", T.StringType()),
])

# Raw JSONL news rows keep published_at as the vendor's string.
NEWS_JSONL = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("published_at", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("url", T.StringType()),
])

UNIVERSE = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("is_benchmark", T.IntegerType()),
])

PREDICTIONS = T.StructType([
    T.StructField("prediction_id", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("ticker", T.StringType()),
    T.StructField("as_of_date", T.DateType()),
    T.StructField("horizon", T.StringType()),
    T.StructField("target_date", T.DateType()),
    T.StructField("current_close", T.DoubleType()),
    T.StructField("predicted_return", T.DoubleType()),
    T.StructField("predicted_close", T.DoubleType()),
    T.StructField("bear_case", T.DoubleType()),
    T.StructField("bull_case", T.DoubleType()),
    T.StructField("confidence_score", T.DoubleType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("model_version", T.StringType()),
    T.StructField("actual_close", T.DoubleType()),
    T.StructField("actual_return", T.DoubleType()),
    T.StructField("absolute_error", T.DoubleType()),
    T.StructField("return_error", T.DoubleType()),
    T.StructField("direction_correct", T.IntegerType()),
    T.StructField("within_prediction_range", T.IntegerType()),
    T.StructField("scored_at", T.TimestampType()),
])

MODEL_RUNS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("model_version", T.StringType()),
    T.StructField("run_type", T.StringType()),
    T.StructField("metrics_json", T.StringType()),
    T.StructField("promoted", T.IntegerType()),
])
