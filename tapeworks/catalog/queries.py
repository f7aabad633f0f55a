"""Spark side of every registered query: ``name -> (spark, sf_dir) -> DataFrame``.

Keys are the lower-case SURVEY IDs. Each query reads the driver tables
through the adapters, so its work grows with the tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as txt
from ..operators import asof
from ..plans import features as feat
from ..plans import evaluation as ev
from ..plans import news_events as ne
from ..plans import outcomes as oc
from ..sources import tables as tb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


PRESENT_DIGITS = 6


def present(df: DataFrame, digits: int = PRESENT_DIGITS) -> DataFrame:
    """Round double columns for comparison with the oracle (same rule in SQL)."""
    return df.select(
        *[
            F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def _run(fn, spark, sf_dir):
    # article days and timestamps are defined in UTC (as in the reference)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return present(fn(spark, sf_dir))


def register(name: str):
    def deco(fn):
        QUERIES[name] = lambda spark, sf_dir: _run(fn, spark, sf_dir)
        QUERIES[name].__doc__ = fn.__doc__
        return fn

    return deco


def features_panel(spark: SparkSession, sf_dir: str, bars: DataFrame | None = None) -> DataFrame:
    """The panel over ``bars``: those written once where a query reads them in several places."""
    return feat.build_features(tb.ohlcv(spark, sf_dir) if bars is None else bars, tb.BENCHMARK_ROLES)


@register("ds_1_feature_panel")
def ds_1(spark, sf_dir):
    return features_panel(spark, sf_dir)


# ---------------------------------------------------------------- as-of joins
CONTEXT_COLUMNS = ["ret_1d", "ret_5d", "volatility_20d", "future_ret_1d", "future_ret_5d", "future_ret_20d"]


@register("join_4_asof_backward")
def join_4(spark, sf_dir):
    """Each article -> latest feature row with date <= its UTC day."""
    feats = features_panel(spark, sf_dir)
    nws = tb.news(spark, sf_dir).select("doc_id", "ticker", "published_at")
    out = asof.asof_backward(
        nws, feats.withColumn("asof_date", F.col("date")), ["ticker"], F.col("published_at"), "date",
        ["asof_date", *CONTEXT_COLUMNS],
    )
    return out.select("doc_id", "ticker", "published_at", "asof_date", *CONTEXT_COLUMNS)


@register("join_6_asof_forward")
def join_6(spark, sf_dir):
    """Each prediction -> first bar with date >= target_date and < target_date + 7."""
    preds = tb.predictions(spark, sf_dir).select("prediction_id", "ticker", "target_date")
    bars = tb.ohlcv(spark, sf_dir).select("ticker", "date", "close")
    out = asof.asof_forward(
        preds, bars, ["ticker"], F.col("target_date"), "date", ["close"], tolerance_days=7, matched_day_col="actual_date"
    )
    return out.select("prediction_id", "ticker", "target_date", "actual_date", F.col("close").alias("actual_close"))


def _recent_news(spark, sf_dir, anchors, anchor_day, n, lookback, body_chars):
    items = tb.news(spark, sf_dir).select(
        "ticker",
        F.to_date("published_at").alias("pday"),
        "published_at",
        "url",
        txt.py_strip(F.col("title")).alias("title"),
        txt.py_strip(F.col("source")).alias("source"),
        F.substring(txt.py_strip(F.col("body")), 1, body_chars).alias("body_excerpt"),
    )
    return asof.trailing_top_n(
        anchors, items, ["ticker"], anchor_day, "pday",
        order=[("pday", False), ("published_at", False), ("url", True)],
        payload=["url", "title", "source", "body_excerpt"], n=n, lookback_days=lookback, out_col="recent_news",
    )


def _flatten_news(df):
    return df.select(
        *[c for c in df.columns if c != "recent_news"],
        F.size("recent_news").alias("n_items"),
        F.array_join(F.transform("recent_news", lambda s: s["url"]), " ").alias("item_urls"),
        F.array_join(F.transform("recent_news", lambda s: s["title"]), "\n").alias("item_titles"),
        F.array_join(F.transform("recent_news", lambda s: s["body_excerpt"]), "\n").alias("item_excerpts"),
    )


@register("join_7_trailing_news")
def join_7(spark, sf_dir):
    """Per (ticker, news day): up to 3 newest articles of the last 7 days, body cut to 220."""
    anchors = tb.news(spark, sf_dir).select("ticker", F.to_date("published_at").alias("date")).distinct()
    return _flatten_news(_recent_news(spark, sf_dir, anchors, "date", 3, 7, 220))


@register("join_8_serving_news")
def join_8(spark, sf_dir):
    """Per prediction: up to 4 newest articles in [as_of - 7, as_of], body cut to 400."""
    anchors = tb.predictions(spark, sf_dir).select("prediction_id", "ticker", "as_of_date")
    return _flatten_news(_recent_news(spark, sf_dir, anchors, "as_of_date", 4, 7, 400))


# ------------------------------------------------------------ news -> events
def news_events(spark, sf_dir):
    return ne.article_events(tb.news(spark, sf_dir))


@register("ds_2_heuristic_payload")
def ds_2(spark, sf_dir):
    """Rule-based payload per article, flattened."""
    n = tb.news(spark, sf_dir)
    p = ne.heuristic_payload(ne.article_text(F.col("title"), F.col("body")))
    return n.select("doc_id", p.alias("p")).select(
        "doc_id", "p.sentiment", "p.sentiment_score", "p.catalyst_type",
        F.array_join("p.risk_flags", ",").alias("risk_flags"), "p.likely_horizon",
    )


@register("ds_3_article_events")
def ds_3(spark, sf_dir):
    """Per-article feature rows (DS-3) keyed by doc_id."""
    n = tb.news(spark, sf_dir)
    rows = ne.article_events(n.withColumn("dedupe_key", F.col("doc_id")))
    return rows.withColumnRenamed("dedupe_key", "doc_id")


@register("agg_1_daily_events")
def agg_1(spark, sf_dir):
    return ne.daily_events(news_events(spark, sf_dir))


@register("join_3_dense_news_features")
def join_3(spark, sf_dir):
    keys = tb.ohlcv(spark, sf_dir).select("ticker", "date")
    return ne.dense_news_features(keys, ne.daily_events(news_events(spark, sf_dir)))


@register("agg_9_distinct_panel_keys")
def agg_9(spark, sf_dir):
    return tb.ohlcv(spark, sf_dir).select("ticker", "date").distinct()


# ------------------------------------------------------------- evaluation
# Split bounds for the driver data (bars run 1995-01 .. 2001-11).
DRIVER_SPLIT = ("2000-01-01", "2000-12-31", "2001-01-01")
# Two fixed linear scorers standing in for a production and a candidate model.
MODEL_A = {"ret_5d": 0.3, "volatility_20d": -0.2, "close_vs_ma20": 0.1}
MODEL_B = {"ret_20d": 0.2, "volume_z20": 0.01, "stock_minus_qqq_ret_5d": 0.3}
MODELS = [("linear_a", "v1", MODEL_A), ("linear_b", "v2", MODEL_B)]
AS_OF = "2002-01-01"


def model_frame(spark, sf_dir, bars=None):
    from ..schemas import PRICE_FEATURE_COLUMNS

    feats = features_panel(spark, sf_dir, bars)
    return ev.prepare_model_frame(feats, PRICE_FEATURE_COLUMNS, "future_ret_5d")


def scored_panel(spark, sf_dir, models=MODELS, bars=None):
    """Every model scores the same prepared panel in one pass: the per-model
    predictions are exploded from an array, so the feature plan runs once."""
    frame = model_frame(spark, sf_dir, bars).withColumn("split", ev.split_column(F.col("date"), DRIVER_SPLIT))
    per_model = F.array(*[
        F.struct(F.lit(name).alias("model_name"), F.lit(ver).alias("model_version"),
                 ev.linear_score(coefs).alias("prediction"))
        for name, ver, coefs in models
    ])
    out = frame.select("*", F.explode(per_model).alias("_m"))
    return out.select("_m.model_name", "_m.model_version", *frame.columns, "_m.prediction")


@register("prj_3_model_frame")
def prj_3(spark, sf_dir):
    from ..schemas import PRICE_FEATURE_COLUMNS

    return model_frame(spark, sf_dir).select("ticker", "date", "close", "future_ret_5d", *PRICE_FEATURE_COLUMNS)


@register("prj_5_split_and_weights")
def prj_5(spark, sf_dir):
    frame = model_frame(spark, sf_dir).select("ticker", "date")
    frame = frame.withColumn("split", ev.split_column(F.col("date"), DRIVER_SPLIT))
    return frame.withColumn("weight", ev.recency_weight(frame, 180))


@register("ml_2_linear_scores")
def ml_2(spark, sf_dir):
    return scored_panel(spark, sf_dir).select("model_name", "model_version", "ticker", "date", "split", "prediction")


@register("agg_5_regression_metrics")
def agg_5(spark, sf_dir):
    return ev.regression_metrics(scored_panel(spark, sf_dir), ["model_name", "model_version", "split"])


@register("agg_8_training_window")
def agg_8(spark, sf_dir):
    frame = model_frame(spark, sf_dir).withColumn("split", ev.split_column(F.col("date"), DRIVER_SPLIT))
    return ev.training_window(frame, ["split"])


@register("agg_7_rebalance_dates")
def agg_7(spark, sf_dir):
    from ..plans.backtest import rebalance_dates

    frame = model_frame(spark, sf_dir).filter(~F.col("ticker").isin(*tb.BENCHMARK_ROLES.values()))
    return rebalance_dates(frame)


def backtest(spark, sf_dir):
    from ..plans.backtest import run_weekly_backtest

    scored = scored_panel(spark, sf_dir, bars=tb.bars_table(spark, sf_dir))
    return run_weekly_backtest(scored, tb.BENCHMARK_ROLES["qqq"], list(tb.BENCHMARK_ROLES.values()))


@register("ds_13_backtest_periods")
def ds_13_periods(spark, sf_dir):
    return backtest(spark, sf_dir)[0]


@register("ds_13_backtest_summary")
def ds_13_summary(spark, sf_dir):
    return backtest(spark, sf_dir)[1]


def outcomes(spark, sf_dir, carry=()):
    preds = tb.predictions(spark, sf_dir)
    return oc.score_outcomes(
        preds, tb.ohlcv(spark, sf_dir), F.lit(AS_OF).cast("date"), F.lit(AS_OF + " 00:00:00").cast("timestamp"), carry=carry
    )


@register("ds_11_outcomes")
def ds_11(spark, sf_dir):
    return outcomes(spark, sf_dir)


@register("ds_12_scorecard")
def ds_12(spark, sf_dir):
    return oc.scorecard(outcomes(spark, sf_dir, carry=["ticker", "confidence", "predicted_return", "predicted_close"]))


# ------------------------------------------------------ promotion, serving
def roles_table(spark):
    """Which scorer plays which role (a two-row parameter table)."""
    return spark.createDataFrame(
        [("production", MODELS[0][0], MODELS[0][1]), ("candidate", MODELS[1][0], MODELS[1][1])],
        "role string, model_name string, model_version string",
    )


def evaluation(spark, sf_dir):
    from ..plans import promote as pm

    return pm.evaluate_models(
        scored_panel(spark, sf_dir, bars=tb.bars_table(spark, sf_dir)), roles_table(spark), tb.BENCHMARK_ROLES["qqq"], list(tb.BENCHMARK_ROLES.values())
    )


@register("ds_14_candidate_evaluation")
def ds_14(spark, sf_dir):
    return evaluation(spark, sf_dir)


@register("ds_15_promotion_gate")
def ds_15(spark, sf_dir):
    from ..plans import promote as pm

    side = pm.side_by_side(evaluation(spark, sf_dir))
    return pm.promotion_decision(side, "ensemble", F.lit(AS_OF + " 00:00:00").cast("timestamp")).select(
        "model_name", "model_version", "run_type", "promoted", "passed"
    )


@register("join_14_side_by_side")
def join_14(spark, sf_dir):
    from ..plans import promote as pm

    return pm.side_by_side(evaluation(spark, sf_dir))


def priors(spark, sf_dir, bars=None):
    from ..plans.forecast import drift_forecast

    return drift_forecast(tb.ohlcv(spark, sf_dir) if bars is None else bars, min_history=120, step=5, lookback=60)


@register("ml_3_drift_priors")
def ml_3(spark, sf_dir):
    return priors(spark, sf_dir)


@register("win_12_forecast_anchors")
def win_12(spark, sf_dir):
    from ..operators.windows import panel_window, strided_anchors

    return strided_anchors(tb.ohlcv(spark, sf_dir).select("ticker", "date", "close"), panel_window(), 120, 5)


@register("win_11_business_day_regrid")
def win_11(spark, sf_dir):
    from ..plans.forecast import business_day_regrid

    return business_day_regrid(tb.ohlcv(spark, sf_dir).select("ticker", "date", "close"))


@register("win_7_latest_rows")
def win_7(spark, sf_dir):
    from ..plans.predict import latest_rows

    return latest_rows(features_panel(spark, sf_dir).select("ticker", "date", "close", "ret_5d", "volatility_20d"))


def dense_news(spark, sf_dir, bars=None):
    keys = (tb.ohlcv(spark, sf_dir) if bars is None else bars).select("ticker", "date")
    return ne.dense_news_features(keys, ne.daily_events(news_events(spark, sf_dir)))


@register("ds_9_predictions")
def ds_9(spark, sf_dir):
    from ..plans.predict import predict_all

    bars = tb.bars_table(spark, sf_dir)
    feats = features_panel(spark, sf_dir, bars)
    # the serving universe: what is no benchmark, and a listed ticker that never traded
    never_traded = spark.range(99, 100).select(F.concat(F.lit("BRAND#"), F.col("id").cast("string")))
    tickers = tb.universe(spark, sf_dir).filter("is_benchmark = 0").select("ticker").union(never_traded)
    out = predict_all(feats, dense_news(spark, sf_dir, bars), priors(spark, sf_dir, bars), ev.linear_score(MODEL_A), tickers=tickers)
    return out.select(
        *[c for c in out.columns if c not in ("main_drivers", "risk_flags")],
        F.array_join("main_drivers", ";").alias("main_drivers"),
        F.array_join("risk_flags", ";").alias("risk_flags"),
    )


@register("ds_10_prior_only_predictions")
def ds_10(spark, sf_dir):
    from ..plans.predict import predict_prior_only

    bars = tb.bars_table(spark, sf_dir)
    out = predict_prior_only(features_panel(spark, sf_dir, bars), priors(spark, sf_dir, bars))
    return out.withColumn("t1_drivers", F.array_join("t1_drivers", ";"))


@register("top_4_recent_predictions")
def top_4(spark, sf_dir):
    from ..plans.predict import recent_predictions

    preds = tb.predictions(spark, sf_dir).withColumn("created_at", F.col("as_of_date").cast("timestamp"))
    return recent_predictions(preds, 25).select("prediction_id", "ticker", "as_of_date", "predicted_return")


# ------------------------------------------------------------- training sets
def _arr(df, cols, sep=";"):
    return df.select(*[F.array_join(c, sep).alias(c) if c in cols else F.col(c) for c in df.columns])


@register("ds_5_outcome_labelled_set")
def ds_5(spark, sf_dir):
    from ..plans.trainsets import outcome_labelled

    out = outcome_labelled(tb.news(spark, sf_dir), features_panel(spark, sf_dir))
    return _arr(out, ["risk_flags"])


@register("ds_6_weak_supervision_set")
def ds_6(spark, sf_dir):
    from ..plans.trainsets import weak_supervision

    return _arr(weak_supervision(tb.news(spark, sf_dir)), ["risk_flags"])


def merged_frame(spark, sf_dir, with_priors=True):
    from ..plans.trainsets import training_frame

    bars = tb.bars_table(spark, sf_dir)
    return training_frame(features_panel(spark, sf_dir, bars), priors(spark, sf_dir, bars) if with_priors else None,
                          dense_news(spark, sf_dir, bars))


@register("join_2_training_frame")
def join_2(spark, sf_dir):
    from ..schemas import NEWS_FEATURE_COLUMNS, PRIOR_FEATURE_COLUMNS

    return merged_frame(spark, sf_dir).select("ticker", "date", "close", "ret_5d", *PRIOR_FEATURE_COLUMNS,
                                              *NEWS_FEATURE_COLUMNS)


@register("join_11_source_sets")
def join_11(spark, sf_dir):
    from ..plans.trainsets import source_sets

    return _arr(source_sets(tb.news(spark, sf_dir)), ["sources_seen"], ",")


@register("ds_7_planner_set")
def ds_7(spark, sf_dir):
    from ..plans.trainsets import planner_rows, source_sets, training_frame

    bars = tb.bars_table(spark, sf_dir)
    frame = training_frame(features_panel(spark, sf_dir, bars), None, dense_news(spark, sf_dir, bars))
    frame = frame.select(*[F.coalesce(F.col(f.name), F.lit(0.0)).alias(f.name) if f.dataType.typeName() == "double"
                           else F.col(f.name) for f in frame.schema.fields])
    out = planner_rows(frame, source_sets(tb.news(spark, sf_dir)))
    return _arr(out, ["triggers", "suggested_sources"])


@register("top_2_tail_rows")
def top_2(spark, sf_dir):
    from ..plans.trainsets import tail_rows

    return tail_rows(features_panel(spark, sf_dir).select("ticker", "date", "close"), 4000)


@register("ds_8_adjuster_set")
def ds_8(spark, sf_dir):
    from ..plans.trainsets import adjuster_rows, recent_news_by_day
    from ..schemas import merged_feature_columns

    frame = ev.prepare_model_frame(merged_frame(spark, sf_dir), merged_feature_columns(), "future_ret_5d")
    out = adjuster_rows(frame, ev.linear_score(MODEL_A), recent_news_by_day(tb.news(spark, sf_dir)))
    return _arr(out, ["cited_signals", "risk_flags"])


@register("ds_17_sft_text")
def ds_17(spark, sf_dir):
    from ..plans.trainsets import sft_text, weak_supervision

    return sft_text(weak_supervision(tb.news(spark, sf_dir)))


# ------------------------------------------------------------ ingestion
INGEST_AS_OF = "2001-12-01 00:00:00"
INGEST_DAYS_BACK = 2000


def _as_of():
    return F.lit(INGEST_AS_OF).cast("timestamp")


def _flat_items(df):
    from ..sources.feeds import iso_utc

    return df.select("payload_id", "ticker", "position", "title", "body", "source", "url",
                     iso_utc(F.col("published_ts")).alias("published_at"))


@register("src_7_rss_items")
def src_7(spark, sf_dir):
    from ..sources.feeds import parse_rss

    pages = tb.table(spark, sf_dir, "pages").select("url", "html")
    return _flat_items(parse_rss(tb.rss_payloads(spark, sf_dir), pages))


@register("src_8_search_items")
def src_8(spark, sf_dir):
    from ..sources.feeds import parse_search

    return _flat_items(parse_search(tb.search_payloads(spark, sf_dir), _as_of()))


@register("src_10_vendor_results")
def src_10(spark, sf_dir):
    from ..sources.feeds import parse_results

    return _flat_items(parse_results(tb.results_payloads(spark, sf_dir)))


@register("str_3_strip_html")
def str_3(spark, sf_dir):
    from ..functions.html import strip_html

    return tb.table(spark, sf_dir, "pages").select("page_id", strip_html(F.col("html")).alias("text"))


@register("str_4_article_body")
def str_4(spark, sf_dir):
    from ..functions.html import article_body

    return tb.table(spark, sf_dir, "pages").select("page_id", article_body(F.col("html")).alias("body"))


def ingest_runs(spark, sf_dir):
    """Run 1 ingests the search feed into an empty log; run 2 ingests the RSS feed
    against run 1's keys (same articles -> duplicates)."""
    from ..plans.ingest import ingest
    from ..sources.feeds import parse_rss, parse_search, rss_errors, search_errors

    cutoff = F.timestamp_add("DAY", F.lit(-INGEST_DAYS_BACK), _as_of())
    s_raw = tb.search_payloads(spark, sf_dir)
    new1, sum1 = ingest(s_raw, parse_search(s_raw, _as_of()), None, cutoff, parse_errors=search_errors(s_raw))
    r_raw = tb.rss_payloads(spark, sf_dir)
    new2, sum2 = ingest(r_raw, parse_rss(r_raw), new1.select("dedupe_key"), cutoff, parse_errors=rss_errors(r_raw))
    return new1, sum1, new2, sum2


@register("ds_16_ingest_new_rows")
def ds_16_rows(spark, sf_dir):
    return ingest_runs(spark, sf_dir)[0]


@register("ds_16_ingest_summary")
def ds_16_summary(spark, sf_dir):
    _, s1, _, s2 = ingest_runs(spark, sf_dir)
    return s1.withColumn("run", F.lit(1)).unionByName(s2.withColumn("run", F.lit(2)))


# ------------------------------------------------------------- streaming
@register("str_m2_daily_events_stream")
def str_m2(spark, sf_dir):
    """AGG-1 as a drained Structured Streaming job (equals the batch result)."""
    from ..streaming.jobs import run_daily_events

    return run_daily_events(spark, tb.news_stream(spark, sf_dir), watermark="7 days")


@register("str_m1_dedupe_stream")
def str_m1(spark, sf_dir):
    """News rows, every one landed twice, deduplicated against a key log by a drained stream."""
    from ..streaming.jobs import run_dedupe

    out = run_dedupe(spark, tb.news_stream(spark, sf_dir).union(tb.news_stream(spark, sf_dir)), days_back=7)
    return out.select("doc_id", "ticker", "published_at")


# ------------------------------------------------------- model responses
def responses(spark, sf_dir):
    """Model responses keyed by article: a payload as fenced JSON that differs from
    the rules' in its confidence and, for every third article, in
    ``company_specific``; every tenth response is damaged (opening brace lost,
    or no JSON)."""
    n = tb.news(spark, sf_dir)
    rules = ne.heuristic_payload(ne.article_text(F.col("title"), F.col("body")))
    p = F.to_json(rules.withField("confidence", F.lit(0.8)).withField("company_specific", F.col("doc_id") % 3 != 0))
    fenced = F.concat(F.lit("```json\n"), p, F.lit("\n```"))
    text = (F.when(F.col("doc_id") % 20 == 0, F.substring(p, F.lit(2), F.length(p)))
            .when(F.col("doc_id") % 20 == 10, F.lit("I could not extract features."))
            .otherwise(fenced))
    return n.withColumn("dedupe_key", F.col("doc_id").cast("string")).withColumn("response", text)


@register("json_1_first_json_object")
def json_1(spark, sf_dir):
    from ..functions.payloads import extract_first_json

    r = responses(spark, sf_dir).select("doc_id", "response")
    out = extract_first_json(r, "response", prefix="{").withColumn("p", F.from_json("payload_json", ne.heur_type()))
    return out.select("doc_id", "parse_error", "p.sentiment", "p.sentiment_score", "p.catalyst_type", "p.company_specific",
                      F.array_join("p.risk_flags", ",").alias("risk_flags"), "p.likely_horizon", "p.confidence")


@register("ds_4_hybrid_daily_events")
def ds_4_hybrid(spark, sf_dir):
    """DS-4 hybrid mode: parsed model payloads, rule fallback per article."""
    from ..functions.payloads import extract_first_json

    r = responses(spark, sf_dir)
    parsed = extract_first_json(r.select("dedupe_key", "response"), "response", prefix="{")
    payloads = parsed.select("dedupe_key", F.from_json("payload_json", ne.heur_type()).alias("payload"))
    events = ne.article_events(r.drop("response"), payloads, mode="hybrid")
    return ne.daily_events(events)


@register("snk_10_failed_tickers")
def snk_10(spark, sf_dir):
    """Universe brands without any bar (empty when every brand traded)."""
    from ..sinks.writers import failed_tickers

    return failed_tickers(tb.universe(spark, sf_dir), tb.ohlcv(spark, sf_dir))


@register("src_5_universe")
def src_5(spark, sf_dir):
    return tb.universe(spark, sf_dir)


@register("ml_1_gbt_test_predictions")
def ml_1(spark, sf_dir):
    """ML-1: gradient-boosted regressor fit on train (+ validation for early
    stopping, recency-weighted), scored on the untouched test split."""
    from ..plans.models import score, train_regressor
    from ..schemas import PRICE_FEATURE_COLUMNS

    feats = features_panel(spark, sf_dir)
    model = train_regressor(feats, PRICE_FEATURE_COLUMNS, split_bounds=DRIVER_SPLIT)
    test = ev.prepare_model_frame(feats, PRICE_FEATURE_COLUMNS, "future_ret_5d").filter(
        ev.split_column(F.col("date"), DRIVER_SPLIT) == "test")
    return score(model, test, PRICE_FEATURE_COLUMNS).select("ticker", "date", "future_ret_5d", "prediction")


@register("str_m3_outcome_stream")
def str_m3(spark, sf_dir):
    """DS-11 driven by a stream of trade files: days that later trades have closed become bars
    and score the matured predictions not scored before; the drained stream's last day counts as ended."""
    from ..streaming.jobs import run_outcome_scoring

    part = tb.table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    preds = tb.predictions(spark, sf_dir)
    out = run_outcome_scoring(
        spark, tb.lineitem_stream(spark, sf_dir), preds, F.lit(AS_OF).cast("date"),
        F.lit(AS_OF + " 00:00:00").cast("timestamp"), bars_fn=lambda batch: tb.bars_from_lineitem(batch, part),
        day=F.col("l_shipdate").cast("date"), final=True,
    )
    return out


@register("join_10_category_lookup")
def join_10(spark, sf_dir):
    """Bars with their universe category ('unknown' when the ticker is not listed)."""
    uni = tb.universe(spark, sf_dir)
    bars = tb.ohlcv(spark, sf_dir).select("ticker", "date", "close")
    out = bars.join(uni.select("ticker", "category"), "ticker", "left")
    return out.withColumn("category", F.coalesce("category", F.lit("unknown")))
