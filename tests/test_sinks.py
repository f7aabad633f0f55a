"""Sinks written and read back."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tapeworks.sinks import writers
from tapeworks.sources import landing, tables

D = dt.date(2024, 1, 2)


def test_panel_is_sorted_and_counted(spark, tmp_path):
    rows = [(t, D + dt.timedelta(days=k % 30), float(k)) for k in range(300) for t in "CAB"]
    n = writers.write_panel(spark.createDataFrame(rows, "ticker string, date date, close double"), str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p"))
    assert n == back.count() == 900
    for part in back.select("ticker", "date").rdd.glom().collect():
        assert [tuple(r) for r in part] == sorted(tuple(r) for r in part)


def test_json_lines_append_and_overwrite(spark, tmp_path):
    from tapeworks.schemas import NEWS_JSONL

    fields = [f.name for f in NEWS_JSONL.fields] if hasattr(NEWS_JSONL, "fields") else [x.split()[0] for x in NEWS_JSONL.split(",")]
    df = spark.createDataFrame([tuple(f"{c}{k}" for c in fields) for k in range(3)], ", ".join(f"{c} string" for c in fields))
    path = str(tmp_path / "log")
    writers.append_jsonl(df, path)
    writers.append_jsonl(df, path)
    assert spark.read.json(path).count() == 6
    assert landing.read_news_jsonl(spark, path).count() == 6
    writers.overwrite_jsonl(df, path)
    lines = spark.read.text(path).collect()
    assert len(lines) == 3 and list(json.loads(lines[0].value)) == sorted(fields)


def test_report_and_manifest(spark, tmp_path):
    writers.write_report_csv(spark.createDataFrame([("mae", 0.1), ("rmse", 0.2)], "metric string, value double"), str(tmp_path / "r"))
    assert len(list((tmp_path / "r").glob("*.csv"))) == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 2
    writers.write_manifest(spark, {"a": float("nan"), "b": [1.0, float("inf")], "c": {"d": 2}}, str(tmp_path / "m"))
    assert json.loads(spark.read.text(str(tmp_path / "m")).first().value) == {"a": None, "b": [1.0, None], "c": {"d": 2}}


def test_tables_take_new_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.append_table(spark.createDataFrame([("x", 1)], "id string, n int"), path)
    writers.append_table(spark.createDataFrame([("y", 2, "new")], "id string, n int, more string"), path)
    assert {(r.id, r.n, r.more) for r in writers.read_table(spark, path).collect()} == {("x", 1, None), ("y", 2, "new")}


def test_failed_tickers_names_a_ticker_without_bars(spark):
    universe = spark.createDataFrame([("A",), ("B",)], "ticker string")
    bars = spark.createDataFrame([("A", D)], "ticker string, date date")
    assert [r.ticker for r in writers.failed_tickers(universe, bars).collect()] == ["B"]


def test_ohlcv_coercion_drops_bad_rows(spark):
    raw = spark.createDataFrame([("A", "2024-01-02", "1", "2", "0.5", "1.5", "x"), ("A", "2024-01-03", "bad", "2", "1", "1", "1")], "ticker string, date string, open string, high string, low string, close string, volume string")
    out = tables.coerce_ohlcv(raw).collect()
    assert [(r.close, r.volume) for r in out] == [(1.5, None)]


def test_a_corrupt_optional_table_is_an_error_not_an_empty_one(spark, tmp_path):
    (tmp_path / "bad.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        landing.load_optional_parquet(spark, str(tmp_path / "bad.parquet"), ["a"]).count()
    assert landing.load_optional_parquet(spark, str(tmp_path / "none.parquet"), ["a"]).count() == 0


def test_wide_context_is_an_option_and_the_default_looks_back_only(spark):
    from tapeworks.plans import trainsets as ts

    assert not any(c.startswith("future") for c in ts.CONTEXT_COLUMNS)
    feats = spark.createDataFrame([("A", D)], "ticker string, date date").select("*", F.lit(0).alias("rapid_move"), *[F.lit(0.03).alias(c) for c in dict.fromkeys([*ts.WIDE_CONTEXT_COLUMNS, *ts.LABEL_COLUMNS])])
    news = spark.createDataFrame([("A", dt.datetime(2024, 1, 2, 9), "t", "b")], "ticker string, published_at timestamp, title string, body string")
    assert "future_ret" not in ts.outcome_labelled(news, feats).first().input
    assert "future_ret_5d" in ts.outcome_labelled(news, feats, ts.WIDE_CONTEXT_COLUMNS).first().input
