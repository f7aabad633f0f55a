"""Instruction-style training sets (DS-5, DS-6, DS-7, DS-8, DS-17, JOIN-2, JOIN-11, TOP-2).

Each builder returns ``(instruction, input, output)`` rows plus the structured
label columns they were rendered from. Text rendering follows the reference's
formats (Python float repr, ``json.dumps(sort_keys=True)``) so the files can
be swapped in; all of it is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import pyfmt as pf
from ..functions.numeric import clamp
from ..functions.matcher import Matcher, any_of, count_of
from ..functions.text import mentions_ticker, py_strip
from ..operators.asof import asof_backward, trailing_top_n
from ..schemas import NEWS_FEATURE_COLUMNS, PRIOR_FEATURE_COLUMNS
from .news_events import catalyst

#: What the model sees by default: nothing that lies after the article. The wide list is an option.
CONTEXT_COLUMNS = ["ret_1d", "ret_5d", "volatility_20d"]
WIDE_CONTEXT_COLUMNS = [*CONTEXT_COLUMNS, "future_ret_1d", "future_ret_5d", "future_ret_20d"]
LABEL_COLUMNS = ["future_ret_1d", "future_ret_5d", "future_ret_10d", "future_ret_20d"]


#: Key words of the outcome-labelled set, and of the weak-supervision set.
OUTCOME_WORDS = Matcher([
    *(w for words in lx.OUTCOME_TOPICS.values() for w in words), *lx.OUTCOME_LEGAL_WORDS, *lx.OUTCOME_VALUATION_WORDS, *lx.OUTCOME_NOVELTY_WORDS,
])
WEAK_WORDS = Matcher([
    *lx.WEAK_POSITIVE_WORDS, *lx.WEAK_NEGATIVE_WORDS, *(w for words in lx.WEAK_TOPICS.values() for w in words),
    *lx.WEAK_SHORT_HORIZON_WORDS, *lx.WEAK_LONG_HORIZON_WORDS, "lawsuit", "litigation", "regulatory", "sec", "antitrust", "guidance", "cut", "lower", "valuation",
])


def _py_max_abs(a: Column, b: Column) -> Column:
    """Python ``max(abs(a), abs(b))`` with NaN (here NULL) semantics: a NULL first
    argument wins; a NULL second argument never does."""
    return F.when(a.isNull(), F.lit(None).cast("double")).when(F.abs(b) > F.abs(a), F.abs(b)).otherwise(F.abs(a))


def outcome_labelled(news: DataFrame, features: DataFrame, context_columns=CONTEXT_COLUMNS) -> DataFrame:
    """DS-5 (R3): extraction targets labelled with the realised outcome of the
    latest bar at or before the article's UTC day (JOIN-4)."""
    right = features.select("ticker", "date", "rapid_move", *dict.fromkeys([*CONTEXT_COLUMNS, *context_columns, *LABEL_COLUMNS]))
    right = right.withColumn("_row", F.lit(True))
    rcols = [c for c in right.columns if c not in ("ticker", "date")]
    base = news.select(
        F.upper("ticker").alias("ticker"), "published_at", "title", "body",
        *(["doc_id"] if "doc_id" in news.columns else []),
    )
    x = asof_backward(base, right, ["ticker"], F.col("published_at"), "date", rcols)
    text = py_strip(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit(""))))
    x = x.withColumn("_text", text).withColumn("_found", OUTCOME_WORDS.found(F.lower(F.col("_text"))))
    has_row = F.coalesce(F.col("_row"), F.lit(False))
    r5 = F.col("future_ret_5d")
    labelled = has_row & r5.isNotNull()  # missing label -> as if no feature row (documented)
    score = F.when(labelled, F.round(clamp(r5 / F.lit(0.08), -1.0, 1.0), 4)).otherwise(F.lit(0.0))
    sentiment = (
        F.when(labelled & (r5 > F.lit(0.02)), F.lit("positive"))
        .when(labelled & (r5 < F.lit(-0.02)), F.lit("negative"))
        .otherwise(F.lit("neutral"))
    )
    s1 = _py_max_abs(F.col("future_ret_1d"), F.col("future_ret_5d"))
    s2 = _py_max_abs(F.col("future_ret_10d"), F.col("future_ret_20d"))
    horizon = F.when(has_row & (s2 > s1), F.lit("5_20_trading_days")).otherwise(F.lit("1_5_trading_days"))
    found = F.col("_found")
    flags = F.array_sort(F.filter(F.array(
        F.when(any_of(found, lx.OUTCOME_LEGAL_WORDS), F.lit("legal_or_regulatory")),
        F.when(any_of(found, lx.OUTCOME_VALUATION_WORDS), F.lit("valuation")),
        F.when(has_row & (F.coalesce(F.col("volatility_20d"), F.lit(0.0)) > F.lit(0.05)), F.lit("high_volatility")),
        F.when(has_row & (F.col("rapid_move") == 1), F.lit("rapid_move")),
    ), lambda f: f.isNotNull()))
    conf = F.round(F.least(
        F.lit(0.55) + F.when(labelled, F.least(F.lit(0.25), F.abs(r5) / F.lit(0.2))).otherwise(F.lit(0.0)),
        F.lit(0.9)), 4)
    novelty = F.when(any_of(found, lx.OUTCOME_NOVELTY_WORDS), F.lit("high")).otherwise(F.lit("medium"))
    x = x.select(
        "*",
        sentiment.alias("sentiment"), score.alias("sentiment_score"),
        catalyst(found, lx.OUTCOME_TOPICS).alias("catalyst_type"),
        mentions_ticker(F.col("_text"), F.col("ticker")).alias("company_specific"),
        flags.alias("risk_flags"), novelty.alias("novelty"), horizon.alias("likely_horizon"),
        conf.alias("confidence"), has_row.alias("_has_row"),
    )
    ctx = F.when(F.col("_has_row"), pf.json_object([(c, pf.py_float(F.col(c))) for c in context_columns])).otherwise(
        F.lit("{}")
    )
    output = pf.json_object([
        ("sentiment", pf.json_str(F.col("sentiment"))),
        ("sentiment_score", pf.py_float(F.col("sentiment_score"))),
        ("catalyst_type", pf.json_str(F.col("catalyst_type"))),
        ("company_specific", pf.json_bool(F.col("company_specific"))),
        ("risk_flags", pf.json_str_list(F.col("risk_flags"))),
        ("novelty", pf.json_str(F.col("novelty"))),
        ("likely_horizon", pf.json_str(F.col("likely_horizon"))),
        ("confidence", pf.py_float(F.col("confidence"))),
    ])
    inp = F.concat(
        F.lit("Ticker: "), F.col("ticker"), F.lit("\nDate: "), F.to_date("published_at").cast("string"),
        F.lit("\nHeadline: "), F.coalesce("title", F.lit("")), F.lit("\nArticle: "), F.coalesce("body", F.lit("")),
        F.lit("\nMarketContext: "), ctx,
    )
    keep = ["doc_id"] if "doc_id" in news.columns else []
    return x.select(
        *keep, "ticker", "published_at", "sentiment", "sentiment_score", "catalyst_type", "company_specific",
        "risk_flags", "novelty", "likely_horizon", "confidence",
        F.lit(lx.INSTRUCTION_EXTRACT).alias("instruction"), inp.alias("input"), output.alias("output"),
    )


def weak_supervision(news: DataFrame, published_at_text: Column | None = None) -> DataFrame:
    """DS-6 (R3b): text-only weak labels."""
    text = py_strip(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit(""))))
    x = news.withColumn("_found", WEAK_WORDS.found(F.lower(text)))
    found = F.col("_found")
    p = count_of(found, lx.WEAK_POSITIVE_WORDS)
    n = count_of(found, lx.WEAK_NEGATIVE_WORDS)
    raw = F.when(p + n == 0, F.lit(0.0)).otherwise((p - n).cast("double") / (p + n).cast("double"))
    x = x.withColumn("_s", raw)
    s = F.col("_s")
    label = F.when(s > F.lit(0.15), F.lit("positive")).when(s < F.lit(-0.15), F.lit("negative")).otherwise(F.lit("neutral"))
    flags = F.filter(F.array(
        F.when(s < F.lit(-0.25), F.lit("negative_sentiment")),
        F.when(any_of(found, ["lawsuit", "litigation"]), F.lit("lawsuit")),
        F.when(any_of(found, ["regulatory", "sec", "antitrust"]), F.lit("regulatory")),
        F.when(any_of(found, ["guidance"]) & any_of(found, ["cut", "lower"]), F.lit("guidance_cut")),
        F.when(any_of(found, ["valuation"]), F.lit("valuation")),
    ), lambda f: f.isNotNull())
    horizon = (
        F.when(any_of(found, lx.WEAK_SHORT_HORIZON_WORDS), F.lit("1-5_trading_days"))
        .when(any_of(found, lx.WEAK_LONG_HORIZON_WORDS), F.lit("5-20_trading_days"))
        .otherwise(F.lit("1-20_trading_days"))
    )
    x = x.select(
        "*", label.alias("sentiment"), F.round(F.abs(s), 4).alias("sentiment_score"),
        catalyst(found, lx.WEAK_TOPICS, "general").alias("catalyst_type"), flags.alias("risk_flags"),
        horizon.alias("likely_horizon"),
    )
    output = pf.json_object([
        ("sentiment", pf.json_str(F.col("sentiment"))),
        ("sentiment_score", pf.py_float(F.col("sentiment_score"))),
        ("catalyst_type", pf.json_str(F.col("catalyst_type"))),
        ("company_specific", F.lit("true")),
        ("risk_flags", pf.json_str_list(F.col("risk_flags"))),
        ("novelty", F.lit('"medium"')),
        ("likely_horizon", pf.json_str(F.col("likely_horizon"))),
        ("confidence", F.lit("0.58")),
    ])
    pub = published_at_text if published_at_text is not None else F.date_format("published_at", "yyyy-MM-dd")
    inp = F.concat(
        F.lit("Ticker: "), F.coalesce(F.col("ticker"), F.lit("UNKNOWN")), F.lit("\nDate: "), F.substring(pub, 1, 10),
        F.lit("\nHeadline: "), F.coalesce("title", F.lit("")), F.lit("\nArticle: "), F.coalesce("body", F.lit("")),
    )
    keep = ["doc_id"] if "doc_id" in news.columns else []
    return x.select(
        *keep, "ticker", "sentiment", "sentiment_score", "catalyst_type", "risk_flags", "likely_horizon",
        F.lit(lx.INSTRUCTION_EXTRACT).alias("instruction"), inp.alias("input"), output.alias("output"),
    )


def training_frame(features: DataFrame, priors: DataFrame | None, news_features: DataFrame | None) -> DataFrame:
    """JOIN-2: features LEFT JOIN priors LEFT JOIN news features on exact (ticker, date).

    Both right sides are keyed (ticker, date), so each join keeps the panel's
    row count; all three are partitioned on the same keys.
    """
    out = features
    if priors is not None:
        out = out.join(priors.select("ticker", "date", *PRIOR_FEATURE_COLUMNS), ["ticker", "date"], "left")
    if news_features is not None:
        out = out.join(news_features.select("ticker", "date", *NEWS_FEATURE_COLUMNS), ["ticker", "date"], "left")
    return out


def tail_rows(df: DataFrame, n: int = 4000) -> DataFrame:
    """TOP-2: the last ``n`` rows of the (ticker, date)-sorted frame (a top-k,
    planned as TakeOrderedAndProject: each task keeps n rows)."""
    return df.orderBy(F.col("ticker").desc(), F.col("date").desc()).limit(n)


def source_sets(news: DataFrame) -> DataFrame:
    """JOIN-11 input: (ticker, day) -> sorted distinct lower-case sources.

    Keyed by the first 10 characters of the ISO timestamp text, as the
    reference does (the day in the article's own offset)."""
    day = F.substring(F.date_format("published_at", "yyyy-MM-dd"), 1, 10).cast("date")
    return news.groupBy(F.upper("ticker").alias("ticker"), day.alias("date")).agg(
        F.array_sort(F.collect_set(F.lower(F.coalesce(F.col("source"), F.lit(""))))).alias("sources_seen")
    )


def planner_rows(frame: DataFrame, sources: DataFrame, horizon: str = "5d") -> DataFrame:
    """DS-7 (R5): retrieval-plan targets from market state and news availability."""
    x = frame.join(sources, ["ticker", "date"], "left").withColumn(
        "sources_seen", F.coalesce(F.col("sources_seen"), F.array().cast("array<string>"))
    )

    def f(c):
        return F.coalesce(F.col(c).cast("double"), F.lit(0.0))

    rapid = F.coalesce(F.col("rapid_move"), F.lit(0)) == 1
    trig = [
        (rapid, "rapid_move", 0.35),
        (f("volatility_20d") > F.lit(0.05), "high_volatility", 0.2),
        (f("news_count") == F.lit(0.0), "missing_news", 0.2),
        ((F.abs(f("future_ret_1d")) > F.lit(0.03)) | (F.abs(f("future_ret_5d")) > F.lit(0.05)), "large_realized_move", 0.15),
        (f("materiality_score") > F.lit(0.6), "material_news_context", 0.1),
        ((f("earnings_count") > 0) | (f("guidance_count") > 0), "earnings_or_guidance", 0.1),
    ]
    score = F.lit(0.1)
    for cond, _, w in trig:  # double arithmetic in the reference's order
        score = F.when(cond, score + F.lit(w)).otherwise(score)
    triggers = F.filter(F.array(*[F.when(c, F.lit(name)) for c, name, _ in trig]), lambda t: t.isNotNull())
    x = x.select("*", score.alias("_score"), triggers.alias("triggers"))
    s = F.col("_score")
    retrieve = s >= F.lit(0.35)
    seen = F.col("sources_seen")
    pre = F.filter(F.array(
        F.when(F.array_contains(F.col("triggers"), "earnings_or_guidance"), F.lit("earnings_transcript")),
        F.when(F.exists(seen, lambda v: F.contains(v, F.lit("investor"))) |
               F.contains(F.array_join(seen, " "), F.lit("investor")), F.lit("company_ir")),
        F.when(F.array_contains(seen, "sec"), F.lit("sec_filings")),
        F.when(F.array_contains(seen, "reuters") | F.array_contains(seen, "yahoo"), F.lit("follow_existing_public_news")),
    ), lambda v: v.isNotNull())
    sources = F.array_distinct(F.concat(pre, F.array(*[F.lit(v) for v in lx.PLANNER_BASE_SOURCES])))
    t = F.col("ticker")
    terms = F.array(F.concat(t, F.lit(" stock news")), F.concat(t, F.lit(" sec filing")),
                    F.concat(t, F.lit(" investor relations")))
    empty = F.array().cast("array<string>")
    x = x.select(
        "*", retrieve.alias("should_retrieve"),
        F.when(s >= F.lit(0.7), F.lit("high")).when(s >= F.lit(0.45), F.lit("medium")).otherwise(F.lit("low")).alias("urgency"),
        F.round(F.least(s, F.lit(0.95)), 4).alias("urgency_score"),
        F.when(retrieve, sources).otherwise(empty).alias("suggested_sources"),
        F.when(retrieve, terms).otherwise(empty).alias("query_terms"),
    )
    output = pf.json_object([
        ("should_retrieve", pf.json_bool(F.col("should_retrieve"))),
        ("urgency", pf.json_str(F.col("urgency"))),
        ("urgency_score", pf.py_float(F.col("urgency_score"))),
        ("triggers", pf.json_str_list(F.col("triggers"))),
        ("suggested_sources", pf.json_str_list(F.col("suggested_sources"))),
        ("query_terms", pf.json_str_list(F.col("query_terms"))),
        ("notes", pf.json_str(F.lit(lx.PLANNER_NOTES))),
    ])
    inp = F.concat(
        F.lit("Ticker: "), t, F.lit("\nDate: "), F.col("date").cast("string"), F.lit(f"\nHorizon: {horizon}"),
        F.lit("\nret_1d: "), pf.fixed(f("ret_1d"), 4), F.lit("\nret_5d: "), pf.fixed(f("ret_5d"), 4),
        F.lit("\nvolatility_20d: "), pf.fixed(f("volatility_20d"), 4),
        F.lit("\nrapid_move: "), F.coalesce(F.col("rapid_move"), F.lit(0)).cast("string"),
        F.lit("\nnews_count: "), pf.fixed(f("news_count"), 0),
        F.lit("\nmateriality_score: "), pf.fixed(f("materiality_score"), 4),
        F.lit("\nsources_seen: "), pf.py_str_list(seen),
    )
    return x.select(
        "ticker", "date", "should_retrieve", "urgency", "urgency_score", "triggers", "suggested_sources",
        F.lit(lx.INSTRUCTION_PLAN).alias("instruction"), inp.alias("input"), output.alias("output"),
    )


def adjuster_rows(frame: DataFrame, baseline: Column, recent: DataFrame | None, horizon: str = "5d") -> DataFrame:
    """DS-8 (R8): adjustment targets. ``recent`` = (ticker, date, recent_news array of
    (title, source, body_excerpt)) for news days only (JOIN-7)."""

    def f(c):
        return F.coalesce(F.col(c).cast("double"), F.lit(0.0))

    x = frame.withColumn("_base", baseline)
    if recent is not None:
        x = x.join(recent.select("ticker", "date", "recent_news"), ["ticker", "date"], "left")
    else:
        x = x.withColumn("recent_news", F.lit(None).cast("array<struct<title:string,source:string,body_excerpt:string>>"))
    news_frac = F.least(f("news_count") / F.lit(3.0), F.lit(1.0))
    weight = F.when(f("news_count") > 0, clamp(
        F.lit(0.25) + F.lit(0.4) * f("materiality_score") + F.lit(0.2) * f("event_confidence_score")
        + F.lit(0.15) * news_frac, 0.0, 1.0)).otherwise(F.lit(0.0))
    resid = (F.col("future_ret_5d") - F.col("_base")) * F.lit(10000.0)
    bps = F.bround(clamp(resid * weight, -150.0, 150.0), 0).cast("int")
    conf = clamp(F.lit(0.25) + F.lit(0.35) * f("materiality_score") + F.lit(0.25) * f("event_confidence_score")
                 + F.lit(0.15) * news_frac, 0.1, 0.95)
    flags = F.filter(F.array(
        F.when(f("volatility_20d") > F.lit(0.05), F.lit("high_volatility")),
        F.when(F.coalesce(F.col("rapid_move"), F.lit(0)) == 1, F.lit("recent_rapid_move")),
        F.when(F.abs(F.col("_base")) > F.lit(0.08), F.lit("large_baseline_move")),
        F.when(f("risk_flag_count") > 0, F.lit("structured_news_risk_flags")),
    ), lambda v: v.isNotNull())
    signals = F.slice(F.filter(F.array(
        F.when(f("earnings_count") > 0, F.lit("earnings_headlines")),
        F.when(f("guidance_count") > 0, F.lit("guidance_change")),
        F.when(f("analyst_count") > 0, F.lit("analyst_activity")),
        F.when(f("regulatory_count") > 0, F.lit("regulatory_context")),
        F.when(f("materiality_score") > F.lit(0.6), F.lit("high_materiality_news")),
        F.when(f("avg_sentiment_stub") > F.lit(0.2), F.lit("positive_sentiment")),
        F.when(f("avg_sentiment_stub") < F.lit(-0.2), F.lit("negative_sentiment")),
    ), lambda v: v.isNotNull()), 1, 5)
    x = x.select("*", bps.alias("adjustment_bps"), F.round(conf, 4).alias("confidence"),
                 flags.alias("risk_flags"), signals.alias("cited_signals"))
    output = pf.json_object([
        ("adjustment_bps", F.col("adjustment_bps").cast("string")),
        ("confidence", pf.py_float(F.col("confidence"))),
        ("rationale", pf.json_str(F.lit(lx.ADJUSTER_RATIONALE))),
        ("cited_signals", pf.json_str_list(F.col("cited_signals"))),
        ("risk_flags", pf.json_str_list(F.col("risk_flags"))),
    ])
    items = F.coalesce(F.col("recent_news"), F.array().cast("array<struct<title:string,source:string,body_excerpt:string>>"))
    news_repr = F.concat(F.lit("["), F.array_join(F.transform(items, lambda s: F.concat(
        F.lit("{'title': "), pf.py_str(s["title"]), F.lit(", 'source': "), pf.py_str(s["source"]),
        F.lit(", 'body_excerpt': "), pf.py_str(s["body_excerpt"]), F.lit("}"))), ", "), F.lit("]"))
    inp = F.concat(
        F.lit("Ticker: "), F.col("ticker"), F.lit("\nDate: "), F.col("date").cast("string"), F.lit(f"\nHorizon: {horizon}"),
        F.lit("\nCurrent close: "), pf.fixed(F.col("close"), 4),
        F.lit("\nBaseline predicted_return: "), pf.fixed(F.col("_base"), 6),
        F.lit("\nVolatility_20d: "), pf.fixed(f("volatility_20d"), 6),
        F.lit("\nBaseline risk flags: "), pf.py_str_list(F.col("risk_flags")),
        F.lit("\nStructured news features: {'news_count': "), pf.fixed(f("news_count"), 0),
        F.lit(", 'avg_sentiment_stub': "), pf.fixed(f("avg_sentiment_stub"), 4),
        F.lit(", 'materiality_score': "), pf.fixed(f("materiality_score"), 4),
        F.lit(", 'event_confidence_score': "), pf.fixed(f("event_confidence_score"), 4), F.lit("}"),
        F.lit("\nRecent news items: "), news_repr,
    )
    return x.select(
        "ticker", "date", F.col("_base").alias("baseline_predicted_return"), "adjustment_bps", "confidence",
        "cited_signals", "risk_flags", F.size(items).alias("n_recent_news"),
        F.lit(lx.INSTRUCTION_ADJUST).alias("instruction"), inp.alias("input"), output.alias("output"),
    )


def recent_news_by_day(news: DataFrame, lookback_days: int = 7, max_items: int = 3, body_chars: int = 220) -> DataFrame:
    """JOIN-7 for DS-8: per (ticker, news day) the newest items of the trailing window."""
    items = news.select(
        F.upper("ticker").alias("ticker"), F.to_date("published_at").alias("pday"), "published_at", "url",
        py_strip(F.col("title")).alias("title"), py_strip(F.col("source")).alias("source"),
        F.substring(py_strip(F.col("body")), 1, body_chars).alias("body_excerpt"),
    )
    anchors = items.select("ticker", F.col("pday").alias("date")).distinct()
    return trailing_top_n(
        anchors, items, ["ticker"], "date", "pday", [("pday", False), ("published_at", False), ("url", True)],
        ["title", "source", "body_excerpt"], max_items, lookback_days, out_col="recent_news",
    )


def sft_text(rows: DataFrame, min_rows: int = 10) -> DataFrame:
    """DS-17: ``Instruction/Input/Output`` text rows. ``check_min_rows`` enforces
    the minimum separately (it needs an action)."""
    return rows.select(F.concat(
        F.lit("Instruction: "), F.col("instruction"), F.lit("\nInput: "), F.col("input"),
        F.lit("\nOutput: "), F.col("output")).alias("text"))


def check_min_rows(rows: DataFrame, min_rows: int = 10) -> int:
    """DS-17 minimum-rows check (one bounded count); raises if too small."""
    n = rows.limit(min_rows).count()
    if n < min_rows:
        raise ValueError(f"Training data too small ({n} rows); need at least {min_rows}.")
    return n
