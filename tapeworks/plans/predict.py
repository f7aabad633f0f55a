"""Serving-time predictions for every ticker in one plan (DS-9, DS-10, JOIN-5,
JOIN-15, WIN-7, TOP-5, SNK-6 ids).

A single ticker is just a filter on these plans; Catalyst pushes it into the
scans. Failures become an ``error`` column instead of exceptions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import bday_offset, parse_horizon
from ..functions.numeric import clamp, confidence_label
from ..operators.asof import latest_before
from ..operators.windows import latest_per_key
from ..schemas import NEWS_FEATURE_COLUMNS, PRICE_FEATURE_COLUMNS, PRIOR_FEATURE_COLUMNS

MAX_ADJUSTMENT_BPS = 150


def latest_rows(features: DataFrame) -> DataFrame:
    """WIN-7: latest row with a close per ticker."""
    return latest_per_key(features, ["ticker"], "date", where=F.col("close").isNotNull())


def feature_drivers(cols: Sequence[str], importances: Mapping[str, float] | None = None, limit: int = 5) -> Column:
    """TOP-5: the ``limit`` columns with the largest abs(value) * max(importance, 1e-8),
    formatted ``name=0.1234``; ties keep column order."""
    items = []
    for idx, c in enumerate(cols):
        v = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        wgt = 1.0 if importances is None else float(importances.get(c, 1.0))
        items.append(F.struct((F.abs(v) * F.lit(max(wgt, 1e-8))).alias("s"), F.lit(-idx).alias("i"),
                              F.lit(c).alias("name"), v.alias("v")))
    top = F.slice(F.sort_array(F.array(*items), asc=False), 1, limit)
    return F.transform(top, lambda s: F.format_string("%s=%.4f", s["name"], s["v"]))


def _conf_step(score: Column, bps: Column, adj_conf: Column) -> Column:
    s1 = F.when(F.abs(bps) >= 100, F.round(clamp(score - F.lit(0.04), 0.2, 0.95), 4)).otherwise(score)
    return F.when(adj_conf < F.lit(0.35), F.round(clamp(s1 - F.lit(0.03), 0.2, 0.95), 4)).otherwise(s1)


def predict_all(
    features: DataFrame,
    news_features: DataFrame,
    priors: DataFrame | None,
    score: Column,
    horizon: str = "5d",
    adjustments: DataFrame | None = None,
    versions: Mapping[str, str] | None = None,
    importances: Mapping[str, float] | None = None,
    feature_columns: Sequence[str] | None = None,
    tickers: DataFrame | None = None,
) -> DataFrame:
    """DS-9 (R10): one prediction per ticker as of its latest bar.

    ``score`` is the baseline model as a column expression over the feature
    columns (ML-2). ``adjustments`` (ticker, as_of_date, adjustment_bps,
    confidence, risk_flags, rationale) is optional; absent rows mean a zero
    adjustment with confidence 0. ``tickers`` restricts the universe
    (non-benchmark tickers); a ticker without bars gets an error row.
    """
    n = parse_horizon(horizon)
    versions = dict(versions or {"t1": "t1", "n1": "n1", "ensemble": "ensemble", "adjuster": "disabled"})
    feature_columns = list(feature_columns or (PRICE_FEATURE_COLUMNS + PRIOR_FEATURE_COLUMNS + NEWS_FEATURE_COLUMNS))
    latest = latest_rows(features.select("ticker", "date", "close", "rapid_move", *PRICE_FEATURE_COLUMNS))
    latest = latest.withColumn("as_of_date", F.col("date"))
    nf = news_features.select("ticker", "date", *NEWS_FEATURE_COLUMNS).withColumn("_news_day", F.col("date"))
    x = latest_before(latest, nf, ["ticker"], "as_of_date", "date", ["_news_day", *NEWS_FEATURE_COLUMNS])
    if priors is not None:
        pr = priors.select("ticker", "date", *PRIOR_FEATURE_COLUMNS)
        x = latest_before(x, pr, ["ticker"], "as_of_date", "date", PRIOR_FEATURE_COLUMNS)
        has_prior = F.col("chronos_pred_ret_5d").isNotNull()
    else:
        x = x.select("*", *[F.lit(None).cast("double").alias(c) for c in PRIOR_FEATURE_COLUMNS])
        has_prior = F.lit(False)
    x = x.withColumn("_has_prior", has_prior).withColumn("_has_news", F.col("_news_day").isNotNull())
    # missing news / prior features count as 0.0, as at serving time in the reference
    x = x.select(
        *[c for c in x.columns if c not in NEWS_FEATURE_COLUMNS + PRIOR_FEATURE_COLUMNS],
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in NEWS_FEATURE_COLUMNS + PRIOR_FEATURE_COLUMNS],
    )
    if adjustments is not None:
        adj = adjustments.select(
            "ticker", F.col("as_of_date").alias("_adj_day"), F.col("adjustment_bps").alias("_bps"),
            F.col("confidence").alias("_adj_conf"), F.col("risk_flags").alias("_adj_flags"),
            F.col("rationale").alias("_rationale"),
        )
        x = x.join(adj, (x.ticker == adj.ticker) & (x.as_of_date == adj._adj_day), "left").drop(adj.ticker).drop("_adj_day")
    else:
        x = x.select("*", F.lit(None).cast("int").alias("_bps"), F.lit(None).cast("double").alias("_adj_conf"),
                     F.lit(None).cast("array<string>").alias("_adj_flags"), F.lit(None).cast("string").alias("_rationale"))
    bps = F.coalesce(F.col("_bps"), F.lit(0)).cast("int")
    adj_conf = F.coalesce(F.col("_adj_conf"), F.lit(0.0))
    vol = F.coalesce(F.nullif(F.col("volatility_20d"), F.lit(0.0)), F.lit(0.02))
    missing_news = F.col("news_count") == F.lit(0.0)
    x = x.withColumn("_baseline", score)
    pred = F.col("_baseline") + bps.cast("double") / F.lit(10000.0)
    x = x.withColumn("_pred", pred).withColumn("_vol", vol).withColumn("_bps_i", bps).withColumn("_adj_c", adj_conf)
    p, v, t1 = F.col("_pred"), F.col("_vol"), F.col("chronos_pred_ret_5d")
    s = F.lit(0.62)
    s = s - F.when(v > F.lit(0.05), F.lit(0.18)).when(v > F.lit(0.03), F.lit(0.08)).otherwise(F.lit(0.0))
    s = s - F.when(missing_news, F.lit(0.08)).otherwise(F.lit(0.0))
    s = s - F.when(F.abs(p) < F.lit(0.005), F.lit(0.08)).otherwise(F.lit(0.0))
    s = s + F.when((F.signum(t1) == F.signum(p)) & (F.abs(t1 - p) < F.lit(0.01)), F.lit(0.08)).otherwise(F.lit(0.0))
    s = F.round(clamp(s, 0.2, 0.95), 4)
    x = x.withColumn("_score", _conf_step(s, F.col("_bps_i"), F.col("_adj_c")))
    spread = F.greatest(v, F.lit(0.015))
    close = F.col("close")
    flags = F.array_distinct(F.concat(
        F.filter(F.array(
            F.when(missing_news, F.lit("missing_news_features")),
            F.when(v > F.lit(0.05), F.lit("high_volatility")),
            F.when(F.col("rapid_move") == 1, F.lit("recent_rapid_move")),
            F.when(F.abs(F.col("_baseline")) > F.lit(0.08), F.lit("large_baseline_move")),
            F.when(F.abs(p) > F.lit(0.08), F.lit("large_adjusted_move")),
            F.when(F.abs(F.col("_bps_i")) >= 100, F.lit("large_llm_adjustment")),
        ), lambda f: f.isNotNull()),
        F.coalesce(F.col("_adj_flags"), F.array().cast("array<string>")),
    ))
    ver = F.lit(f"t1={versions.get('t1')};n1={versions.get('n1')};ensemble={versions.get('ensemble')};"
                f"adjuster={versions.get('adjuster')}")
    out = x.select(
        F.sha2(F.concat_ws("|", F.col("ticker"), F.col("as_of_date").cast("string"), F.lit(horizon), ver), 256)
        .alias("prediction_id"),
        "ticker", "as_of_date", F.lit(horizon).alias("target_horizon"),
        bday_offset(F.col("as_of_date"), n).alias("target_date"),
        F.round(close, 4).alias("current_close"),
        F.round(close * (F.lit(1.0) + F.col("_baseline")), 4).alias("baseline_expected_close"),
        F.round(F.col("_baseline"), 6).alias("baseline_predicted_return"),
        F.col("_bps_i").alias("adjustment_bps"),
        F.round(close * (F.lit(1.0) + p), 4).alias("expected_close"),
        F.round(p, 6).alias("predicted_return"),
        F.round(close * (F.lit(1.0) + p - spread), 4).alias("bear_case"),
        F.round(close * (F.lit(1.0) + p + spread), 4).alias("bull_case"),
        confidence_label(F.col("_score")).alias("confidence"),
        F.col("_score").alias("confidence_score"),
        feature_drivers(feature_columns, importances).alias("main_drivers"),
        flags.alias("risk_flags"),
        F.coalesce(F.col("_rationale"), F.lit("No adjustment applied.")).alias("reasoning"),
        F.lit(None).cast("string").alias("error"),
        F.col("_has_prior").alias("_has_prior_out"),
    )
    if priors is not None:
        err = F.when(~F.col("_has_prior_out"), F.concat(
            F.lit("No prior features available for ticker "), F.col("ticker"), F.lit(" as of "),
            F.col("as_of_date").cast("string")))
        out = out.withColumn("error", err)
        out = out.select(*[
            F.col(c) if c in ("ticker", "error") else F.when(F.col("error").isNull(), F.col(c)).alias(c)
            for c in out.columns if c != "_has_prior_out"
        ])
    if tickers is not None:
        missing = tickers.select("ticker").join(out.select("ticker"), "ticker", "left_anti")
        err = missing.select(
            *[F.lit(None).cast(f.dataType).alias(f.name) if f.name not in ("ticker", "error") else
              (F.col("ticker") if f.name == "ticker" else F.concat(F.lit("No features found for ticker "), F.col("ticker")).alias("error"))
              for f in out.schema.fields]
        )
        out = out.join(tickers.select("ticker"), "ticker", "left_semi").unionByName(err)
    return out


def predict_prior_only(features: DataFrame, priors: DataFrame) -> DataFrame:
    """DS-10: prior-only prediction per ticker; ``error`` when no prior row exists."""
    latest = latest_rows(features.select("ticker", "date", "close")).withColumn("as_of_date", F.col("date"))
    x = latest_before(latest, priors.select("ticker", "date", *PRIOR_FEATURE_COLUMNS).withColumn("_pday", F.col("date")),
                      ["ticker"], "as_of_date", "date", ["_pday", *PRIOR_FEATURE_COLUMNS])
    pr = F.coalesce(F.col("chronos_pred_ret_5d"), F.lit(0.0))
    return x.select(
        "ticker", "as_of_date", F.col("close").alias("current_close"),
        F.when(F.col("_pday").isNotNull(), pr).alias("t1_predicted_return"),
        F.when(F.col("_pday").isNotNull(), F.col("close") * (F.lit(1.0) + pr)).alias("t1_expected_close"),
        F.when(F.col("_pday").isNotNull(), feature_drivers(PRIOR_FEATURE_COLUMNS)).alias("t1_drivers"),
        F.when(F.col("_pday").isNull(),
               F.concat(F.lit("No prior features available for ticker "), F.col("ticker"))).alias("error"),
    )


def recent_predictions(predictions: DataFrame, n: int = 25) -> DataFrame:
    """TOP-4: the ``n`` newest predictions per ticker (row_number <= n runs as a
    partial WindowGroupLimit before the shuffle)."""
    from pyspark.sql import Window

    w = Window.partitionBy("ticker").orderBy(F.col("created_at").desc(), F.col("prediction_id").asc())
    return predictions.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")
