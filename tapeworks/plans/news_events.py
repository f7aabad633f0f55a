"""News -> daily event features (DS-2, DS-3, DS-4, AGG-1, JOIN-3).

Per-article work is column expressions only: the text is lower-cased and read
once for all key words (``functions/matcher.py``), the rules then look at the
few words found. The daily aggregation is a hash aggregate with
map-side partial aggregation: a ticker-day holding a third of all articles
is reduced to one partial row per map task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions.numeric import clamp
from ..functions.matcher import Matcher, any_of, count_of
from ..functions.text import py_strip

PAYLOAD_FIELDS = [
    "sentiment", "sentiment_score", "catalyst_type", "company_specific", "risk_flags", "novelty",
    "likely_horizon", "confidence",
]


#: All key words of the heuristic rules and the topic counts.
NEWS_WORDS = Matcher([
    *lx.POSITIVE_WORDS, *lx.NEGATIVE_WORDS, *(w for words in lx.TOPIC_KEYWORDS.values() for w in words),
    *lx.LEGAL_FLAG_WORDS, "guidance", *lx.GUIDANCE_CUT_WORDS, *lx.LONG_HORIZON_WORDS,
])


def article_text(title: Column, body: Column, sep: str = " ") -> Column:
    """``f"{title}{sep}{body}".strip()`` with missing parts as ''."""
    return py_strip(F.concat(F.coalesce(title, F.lit("")), F.lit(sep), F.coalesce(body, F.lit(""))))


def catalyst(found: Column, topics: dict[str, list[str]], default: str = "general_news") -> Column:
    """First topic (in dict order) with any keyword present."""
    out = F.lit(default)
    for topic in reversed(list(topics)):
        out = F.when(any_of(found, topics[topic]), F.lit(topic)).otherwise(out)
    return out


def heuristic_payload(text: Column) -> Column:
    """DS-2 (R1): the rule-based event payload of one article, as a struct."""
    return bound(NEWS_WORDS.found(F.lower(text)), payload_of)


def payload_of(found: Column) -> Column:
    """DS-2 from the key words found in the lower-cased text."""
    counts = F.struct(count_of(found, lx.POSITIVE_WORDS).alias("p"), count_of(found, lx.NEGATIVE_WORDS).alias("n"))
    return bound(counts, lambda c: bound(_raw_score(c["p"], c["n"]), lambda raw: _rules(found, raw)))


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _raw_score(p: Column, n: Column) -> Column:
    return F.when(p + n == 0, F.lit(0.0)).otherwise((p - n).cast("double") / (p + n).cast("double"))


def _rules(found: Column, raw: Column) -> Column:
    label = (
        F.when(raw > F.lit(lx.SENTIMENT_CUT), F.lit("positive"))
        .when(raw < F.lit(-lx.SENTIMENT_CUT), F.lit("negative"))
        .otherwise(F.lit("neutral"))
    )
    flags = F.filter(
        F.array(
            F.when(any_of(found, lx.LEGAL_FLAG_WORDS), F.lit("legal_or_regulatory")),
            F.when(any_of(found, ["guidance"]) & any_of(found, lx.GUIDANCE_CUT_WORDS), F.lit("guidance_cut")),
        ),
        lambda x: x.isNotNull(),
    )
    horizon = F.when(any_of(found, lx.LONG_HORIZON_WORDS), F.lit("5_20_trading_days")).otherwise(
        F.lit("1_5_trading_days")
    )
    return F.struct(
        label.alias("sentiment"),
        F.round(raw, 4).alias("sentiment_score"),
        catalyst(found, lx.TOPIC_KEYWORDS).alias("catalyst_type"),
        F.lit(True).alias("company_specific"),
        flags.alias("risk_flags"),
        F.lit("medium").alias("novelty"),
        horizon.alias("likely_horizon"),
        F.lit(lx.HEURISTIC_CONFIDENCE).alias("confidence"),
    )


def novelty_score(novelty: Column) -> Column:
    low = F.lower(F.coalesce(novelty.cast("string"), F.lit("None")))
    out = F.lit(lx.NOVELTY_DEFAULT)
    for name, value in reversed(list(lx.NOVELTY_SCORES.items())):
        out = F.when(low == F.lit(name), F.lit(value)).otherwise(out)
    return out


def payload_to_row(payload: Column, found: Column) -> list[Column]:
    """DS-3 (R2): per-article feature columns from a payload struct and the key words found."""
    score = F.coalesce(payload["sentiment_score"].cast("double"), F.lit(0.0))
    company = F.when(F.coalesce(payload["company_specific"].cast("boolean"), F.lit(False)), F.lit(1.0)).otherwise(
        F.lit(0.0)
    )
    conf = F.coalesce(payload["confidence"].cast("double"), F.lit(0.0))
    cols = [
        F.lit(1.0).alias("news_count"),
        score.alias("avg_sentiment_stub"),
        F.greatest(score, F.lit(0.0)).alias("max_positive_sentiment_stub"),
        F.least(score, F.lit(0.0)).alias("max_negative_sentiment_stub"),
        company.alias("company_specific_score"),
        (F.lit(1.0) - company).alias("macro_relevance_score"),
        novelty_score(payload["novelty"]).alias("novelty_score"),
        F.least(F.lit(1.0), F.abs(score) * F.lit(0.5) + conf * F.lit(0.5)).alias("materiality_score"),
        conf.alias("event_confidence_score"),
        F.coalesce(F.size(payload["risk_flags"]), F.lit(0)).cast("long").alias("risk_flag_count"),
    ]
    cols += [any_of(found, words).cast("long").alias(f"{t}_count") for t, words in lx.TOPIC_KEYWORDS.items()]
    return cols


def article_events(news: DataFrame, payloads: DataFrame | None = None, mode: str = "heuristic") -> DataFrame:
    """DS-4 per-article rows: (ticker, date, 16 feature columns).

    ``mode``: ``heuristic`` uses the rules; ``model`` uses ``payloads``
    (``dedupe_key, payload struct, parse_error``) and fails if any article has
    no valid payload; ``hybrid`` falls back to the rules per article.
    """
    # blanks at the ends hold no key word, so the text need not be stripped
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("body", F.lit("")))
    base = news.select(
        F.upper(F.col("ticker")).alias("ticker"),
        F.to_date("published_at").alias("date"),
        NEWS_WORDS.found(F.lower(text)).alias("_found"),
        *(["dedupe_key"] if "dedupe_key" in news.columns else []),
    )
    if mode == "heuristic":
        with_payload = base.withColumn("_payload", payload_of(F.col("_found")))
    elif mode in ("model", "hybrid"):
        if payloads is None:
            raise ValueError(f"mode={mode} needs a payload table")
        joined = base.join(payloads.select("dedupe_key", F.col("payload").alias("_model")), "dedupe_key", "left")
        if mode == "model":
            joined = joined.withColumn(
                "_model",
                F.when(F.col("_model").isNull(), F.raise_error(F.concat(F.lit("no model payload for "), F.col("dedupe_key"))))
                .otherwise(F.col("_model")),
            )
            with_payload = joined.withColumn("_payload", F.col("_model"))
        else:
            heur = payload_of(F.col("_found"))
            with_payload = joined.withColumn(
                "_payload", F.when(F.col("_model").isNull(), heur).otherwise(F.col("_model").cast(heur_type()))
            )
    else:
        raise ValueError(f"Unsupported build mode: {mode}")
    keys = ["dedupe_key"] if "dedupe_key" in news.columns else []
    return with_payload.select(*keys, "ticker", "date", *payload_to_row(F.col("_payload"), F.col("_found")))


def heur_type():
    from pyspark.sql import types as T

    return T.StructType([
        T.StructField("sentiment", T.StringType()),
        T.StructField("sentiment_score", T.DoubleType()),
        T.StructField("catalyst_type", T.StringType()),
        T.StructField("company_specific", T.BooleanType()),
        T.StructField("risk_flags", T.ArrayType(T.StringType())),
        T.StructField("novelty", T.StringType()),
        T.StructField("likely_horizon", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
    ])


SUM_COLS = ["news_count", "earnings_count", "guidance_count", "ai_count", "lawsuit_count", "analyst_count",
            "regulatory_count", "risk_flag_count"]
MEAN_COLS = ["avg_sentiment_stub", "company_specific_score", "macro_relevance_score", "event_confidence_score"]
MAX_COLS = ["max_positive_sentiment_stub", "novelty_score", "materiality_score"]
MIN_COLS = ["max_negative_sentiment_stub"]


def daily_events(events: DataFrame) -> DataFrame:
    """AGG-1: one row per (ticker, date) with sum/mean/max/min of article rows."""
    aggs = (
        [F.sum(c).alias(c) for c in SUM_COLS]
        + [F.avg(c).alias(c) for c in MEAN_COLS]
        + [F.max(c).alias(c) for c in MAX_COLS]
        + [F.min(c).alias(c) for c in MIN_COLS]
    )
    return events.groupBy("ticker", "date").agg(*aggs)


def dense_news_features(panel_keys: DataFrame, daily: DataFrame, roll_to_next_trading_day: bool = False) -> DataFrame:
    """JOIN-3: every (ticker, date) of the price panel with its day's events, missing -> 0.

    By default events on days without a bar are dropped, as in the reference
    (R4). ``roll_to_next_trading_day`` moves them to the ticker's next bar
    (forward as-of) before aggregating again.
    """
    from ..schemas import NEWS_FEATURE_COLUMNS

    keys = panel_keys.select("ticker", "date").distinct()
    if roll_to_next_trading_day:
        from ..operators.asof import asof_forward

        moved = asof_forward(
            daily.withColumnRenamed("date", "_eday"), keys.withColumn("_bar", F.col("date")), ["ticker"],
            F.col("_eday"), "date", ["_bar"],
        )
        daily = daily_from_daily(moved.filter(F.col("_bar").isNotNull()).withColumn("date", F.col("_bar")))
    out = keys.join(daily, ["ticker", "date"], "left")
    return out.select(
        "ticker", "date", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in NEWS_FEATURE_COLUMNS]
    )


def daily_from_daily(df: DataFrame) -> DataFrame:
    """Re-aggregate daily rows that were moved onto the same bar (sums of
    sums; means weighted by news_count)."""
    w = F.col("news_count")
    aggs = (
        [F.sum(c).alias(c) for c in SUM_COLS]
        + [(F.sum(F.col(c) * w) / F.sum(w)).alias(c) for c in MEAN_COLS]
        + [F.max(c).alias(c) for c in MAX_COLS]
        + [F.min(c).alias(c) for c in MIN_COLS]
    )
    return df.groupBy("ticker", "date").agg(*aggs)


__all__ = [
    "article_events", "catalyst", "clamp", "daily_events", "dense_news_features", "heuristic_payload",
    "payload_to_row",
]
