"""Bars written once: equal to the aggregate, and read without an exchange by ticker."""

import re

from pyspark.sql import functions as F

from tapeworks.catalog import queries as q
from tapeworks.operators.windows import panel_window
from tapeworks.sources import tables as tb

SF_SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_written_bars_equal_the_aggregate(spark):
    written, made = tb.bars_table(spark, SF_SMALL), tb.ohlcv(spark, SF_SMALL)
    assert written.columns == made.columns
    assert written.exceptAll(made).count() == made.exceptAll(written).count() == 0


def test_windows_and_joins_by_ticker_need_no_exchange(spark):
    bars = tb.bars_table(spark, SF_SMALL)
    lagged = bars.withColumn("before", F.lag("close").over(panel_window()))
    assert "Exchange" not in plan(lagged)
    other = bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
    assert not re.search(r"(?<!Broadcast)Exchange hash", plan(lagged.join(other.hint("merge"), "ticker")))


def test_predictions_read_trades_once(spark):
    out = q.QUERIES["ds_9_predictions"](spark, SF_SMALL)
    p = plan(out)
    assert "l_orderkey" not in p and p.count("tapeworks_bars_") >= 2  # trades were read when the bars were written
    assert out.count() > 0
