"""DS-1 feature panel: exact cases (labels, full-window guards, buckets, context)."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeworks.plans.features import build_features, group_features
from tapeworks.schemas import OHLCV


def bars(spark, closes, ticker="AAA", start=dt.date(2024, 1, 1), volume=1_000_000.0):
    days = pd.bdate_range(start, periods=len(closes))
    rows = [(ticker, d.date(), float(c), float(c) + 1, float(c) - 1, float(c), float(volume)) for d, c in zip(days, closes)]
    return spark.createDataFrame(rows, OHLCV)


def test_future_return_label(spark):
    df = group_features(bars(spark, list(range(100, 120)))).orderBy("date").toPandas()
    assert df.loc[0, "future_ret_5d"] == pytest.approx(105 / 100 - 1)
    assert pd.isna(df.loc[19, "future_ret_1d"])


def test_full_window_guards(spark):
    df = group_features(bars(spark, [100 + i for i in range(260)])).orderBy("date").toPandas()
    assert pd.isna(df.loc[198, "ma200"]) and not pd.isna(df.loc[199, "ma200"])
    assert df.iloc[-1]["volume_ratio_20"] > 0
    # constant volume: std 0 -> z-score 0, ratio 1
    assert df.iloc[-1]["volume_z20"] == 0.0 and df.iloc[-1]["volume_ratio_20"] == pytest.approx(1.0)
    assert pd.isna(df.loc[3, "volatility_5d"]) and not pd.isna(df.loc[5, "volatility_5d"])


def test_bucket_edges(spark):
    from tapeworks.functions.numeric import return_bucket

    vals = [-0.05, -0.01, 0.01, 0.05, 0.2, None]
    df = spark.createDataFrame([(v,) for v in vals], "r double").select(return_bucket(F.col("r")).alias("b"))
    assert [r.b for r in df.collect()] == [0.0, 1.0, 2.0, 3.0, 4.0, None]


def test_zero_close_single_row_missing_benchmark(spark):
    df = build_features(bars(spark, [0.0, 10.0, 0.0]), {"qqq": "QQQ", "spy": "SPY"}).orderBy("date").toPandas()
    assert pd.isna(df.loc[1, "ret_1d"])  # 10 / 0
    assert df.loc[2, "ret_1d"] == -1.0
    assert df["qqq_ret_1d"].isna().all()
    one = build_features(bars(spark, [5.0]), {"qqq": "QQQ", "spy": "SPY"}).toPandas()
    assert len(one) == 1 and pd.isna(one.loc[0, "ret_1d"])


def test_benchmark_context(spark):
    a = bars(spark, [100, 101, 102, 103, 104, 105, 106], "AAA")
    q = bars(spark, [50, 50, 50, 50, 50, 55, 55], "QQQ")
    df = build_features(a.unionByName(q), {"qqq": "QQQ", "spy": "SPY"}).filter("ticker = 'AAA'").orderBy("date").toPandas()
    assert df.loc[5, "qqq_ret_5d"] == pytest.approx(0.1)
    assert df.loc[5, "stock_minus_qqq_ret_5d"] == pytest.approx(105 / 100 - 1 - 0.1)


def test_no_look_ahead(spark):
    full = group_features(bars(spark, [100 + (i % 7) * 3 for i in range(80)])).orderBy("date").toPandas()
    cut = group_features(bars(spark, [100 + (i % 7) * 3 for i in range(60)])).orderBy("date").toPandas()
    cols = ["ret_5d", "volatility_20d", "ma50", "volume_z20", "close_vs_20d_high"]
    pd.testing.assert_frame_equal(full.loc[:59, cols], cut.loc[:59, cols])


def test_plan_single_window_exchange(spark):
    from tapeworks.sources import tables as tb

    df = group_features(tb.ohlcv(spark, "/root/testdata/sf0.001"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
