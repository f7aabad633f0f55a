"""Evaluation, serving, parsing and training-set known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapeworks.functions.dates import bday_offset


def test_business_day_offset_matches_pandas(spark):
    import pandas as pd

    starts = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(21)]
    rows = [(d, n) for d in starts for n in range(1, 41)]
    df = spark.createDataFrame(rows, "d date, n int").select("d", "n", bday_offset(F.col("d"), F.col("n")).alias("o"))
    for r in df.collect():
        assert r.o == (pd.Timestamp(r.d) + pd.offsets.BDay(r.n)).date()


def test_heuristic_payload_and_html(spark):
    from tapeworks.functions.html import strip_html
    from tapeworks.plans.news_events import heuristic_payload

    df = spark.createDataFrame([("Strong growth beat; guidance cut by SEC probe",)], "t string")
    p = df.select(heuristic_payload(F.col("t")).alias("p")).first().p
    assert p.sentiment == "positive" and p.sentiment_score == 0.5
    assert p.catalyst_type == "guidance" and "guidance_cut" in p.risk_flags
    h = spark.createDataFrame([("<b>Demand</b> remains &amp; strong",)], "h string")
    assert h.select(strip_html(F.col("h")).alias("x")).first().x == "Demand remains & strong"


def test_search_envelope_and_relative_time(spark):
    from tapeworks.sources.feeds import parse_search

    env = ('{"status_code": 200, "headers": {}, "body": "{\\"news\\": [{\\"title\\": \\"Apple beats\\", '
           '\\"url\\": \\"https://x.com/a\\", \\"source\\": \\"Reuters\\", \\"date\\": \\"2 hours ago\\", '
           '\\"description\\": \\"<b>Demand</b> remains strong\\"}]}"}')
    raw = spark.createDataFrame([("p1", "AAPL", env)], "payload_id string, ticker string, payload string")
    r = parse_search(raw, F.lit("2026-06-26 12:00:00").cast("timestamp")).first()
    assert r.title == "Apple beats" and r.body == "Demand remains strong" and r.source == "Reuters"
    assert r.published_ts == dt.datetime(2026, 6, 26, 10, 0, 0)


def test_first_json_object_with_prefix(spark):
    from tapeworks.functions.payloads import extract_first_json

    df = spark.createDataFrame([('"a": 1, "b": [2]}',), ("```json\n{\"x\": 1}\n```",), ("nothing",)], "t string")
    out = extract_first_json(df, "t", prefix="{").collect()
    assert out[0].payload_json == '{"a":1,"b":[2]}'
    assert out[1].payload_json == '{"x":1}'
    assert out[2].payload_json is None and out[2].parse_error


def test_adjustment_coercion(spark):
    from tapeworks.functions.payloads import coerce_adjustment

    df = spark.createDataFrame([('{"adjustment_bps": 230.5, "confidence": 1.7, "rationale": " r ", '
                                 '"cited_signals": ["a","b","c","d","e","f","g"], "risk_flags": []}',),
                                ('{"adjustment_bps": 2}',)], "j string")
    a, b = df.select(coerce_adjustment(F.col("j")).alias("c")).collect()
    assert a.c.value.adjustment_bps == 150 and a.c.value.confidence == 1.0 and len(a.c.value.cited_signals) == 6
    assert b.c.value is None and "confidence" in b.c.error


def test_backtest_sign_kept(spark):
    from tapeworks.plans.backtest import summary, with_equity_curve

    p = spark.createDataFrame([("m", "v", dt.date(2024, 1, 1), -1.5, 0.0, "A"), ("m", "v", dt.date(2024, 1, 8), 0.2, 0.0, "A")],
                              "model_name string, model_version string, date date, portfolio_return double, "
                              "benchmark_return double, tickers string")
    s = summary(with_equity_curve(p)).first()
    assert s.total_return == pytest.approx((1 - 1.5) * 1.2 - 1)


def test_prediction_known_answer(spark):
    """Baseline .02 and 30 bps give .023; tickers without bars or priors get error rows."""
    from tapeworks.plans.predict import predict_all
    from tapeworks.schemas import NEWS_FEATURE_COLUMNS, PRICE_FEATURE_COLUMNS, PRIOR_FEATURE_COLUMNS

    day = dt.date(2024, 3, 1)
    keys = spark.createDataFrame([("A", day, 100.0, 0), ("B", day, 50.0, 0)], "ticker string, date date, close double, rapid_move int")
    feats = keys.select("*", *[F.lit(0.01).alias(c) for c in PRICE_FEATURE_COLUMNS if c not in keys.columns])
    news = keys.select("ticker", "date", *[F.lit(1.0).alias(c) for c in NEWS_FEATURE_COLUMNS])
    priors = keys.filter("ticker = 'A'").select("ticker", F.date_sub("date", 3).alias("date"), *[F.lit(0.02).alias(c) for c in PRIOR_FEATURE_COLUMNS])
    adj = spark.createDataFrame([("A", day, 30, 0.9, ["f"], "why")], "ticker string, as_of_date date, adjustment_bps int, confidence double, risk_flags array<string>, rationale string")
    tickers = spark.createDataFrame([("A",), ("B",), ("C",)], "ticker string")
    got = {r.ticker: r for r in predict_all(feats, news, priors, F.lit(0.02), adjustments=adj, tickers=tickers).collect()}
    assert got["A"].predicted_return == pytest.approx(0.023) and got["A"].expected_close == pytest.approx(102.3)
    assert got["A"].adjustment_bps == 30 and "f" in got["A"].risk_flags and got["A"].reasoning == "why" and got["A"].error is None
    assert got["B"].error.startswith("No prior features") and got["C"].error == "No features found for ticker C"


def test_plugin_forecaster_equals_drift(spark):
    """The plug-in path with the drift model gives the built-in forecaster's rows."""
    import numpy as np

    from tapeworks.plans.forecast import Z90, drift_forecast, plugin_forecast

    rng = np.random.default_rng(1)
    rows = [(t, dt.date(2024, 1, 1) + dt.timedelta(days=k), float(c)) for t in ("A", "B") for k, c in enumerate(100 * np.exp(np.cumsum(rng.normal(0, 0.02, 70))))]
    bars = spark.createDataFrame(rows, "ticker string, date date, close double")

    def drift(histories, horizon):
        out = np.empty((len(histories), 3, horizon))
        for i, x in enumerate(histories):
            lr = np.diff(np.log(x))
            mu, sd, h = lr.mean(), lr.std(ddof=1), np.arange(1, horizon + 1)
            for k, z in enumerate((0.0, -Z90, Z90)):
                out[i, k] = x[-1] * np.exp(mu * h + z * sd * np.sqrt(h))
        return out

    key = lambda r: (r.ticker, r.date)
    want = {key(r): tuple(r)[2:] for r in drift_forecast(bars, min_history=30, step=7, lookback=15).collect()}
    got = {key(r): tuple(r)[2:] for r in plugin_forecast(bars, drift, min_history=30, step=7, context=16).collect()}
    assert got.keys() == want.keys() and len(got) == 2 * 41
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_envelope_text_forms(spark):
    import json

    from tapeworks.functions.payloads import envelope_text

    forms = [
        {"choices": [{"message": {"content": "hi"}}]}, {"choices": [{"message": {"content": [{"text": "a"}, {"type": "image"}, {"text": "b"}]}}]},
        {"choices": [{"text": "old"}]}, {"output_text": ["x", "y"]}, {"text": " t "}, {"response": {"choices": [{"message": {"content": "in"}}]}}, {"other": 1},
    ]
    df = spark.createDataFrame([(k, json.dumps(f)) for k, f in enumerate(forms)], "k int, r string")
    got = [r.t for r in df.select("k", envelope_text(F.col("r")).alias("t")).orderBy("k").collect()]
    assert got == ["hi", "a\nb", "old", "x\ny", "t", "in", None]


def test_one_bad_cell_does_not_fail_vendor_prices(spark):
    from tapeworks.sources.landing import normalise_vendor_prices

    raw = spark.createDataFrame([("2024-01-02", "10", "11", "9", "10.5", "7"), ("not a day", "x", "1", "1", "1", "n/a"), ("2024-01-03", "1", "1", "1", "1", "n/a")],
                                "Date string, Open string, High string, Low string, Close string, Volume string")
    out = sorted(normalise_vendor_prices(raw, "msft").collect(), key=lambda r: str(r.date))
    assert [(r.close, r.volume) for r in out] == [(10.5, 7.0), (1.0, None)]


def test_landing_readers(spark, tmp_path):
    from tapeworks.sources.landing import load_optional_parquet, normalise_vendor_prices

    empty = load_optional_parquet(spark, str(tmp_path / "missing.parquet"), ["a", "b"])
    assert empty.count() == 0 and empty.columns == ["ticker", "date", "a", "b"]
    raw = spark.createDataFrame([("2024-01-02", 10.0, 11.0, 9.0, 10.0, 5.0, 100.0), ("2024-01-03", None, 1.0, 1.0, 1.0, 1.0, 1.0)],
                                "Date string, Open double, High double, Low double, Close double, `Adj Close` double, Volume double")
    out = normalise_vendor_prices(raw, "aapl").collect()
    assert len(out) == 1 and out[0].ticker == "AAPL" and out[0].close == 5.0 and out[0].open == 5.0
    assert out[0].volume == 100.0 and out[0].category == "unknown"
