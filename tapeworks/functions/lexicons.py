"""Keyword lexicons of the heuristic news rules.

Fixed values: these word lists and their topic order must equal the
reference's so that heuristic payloads match. Matching is by lower-case
substring (so "said" contains "ai"), on purpose.
"""

from __future__ import annotations

# --- fixed values: daily event features (heuristic payload) ----------------
POSITIVE_WORDS = ["beat", "strong", "growth", "upbeat", "surge", "record", "expand", "positive", "upgrade"]
NEGATIVE_WORDS = ["miss", "weak", "cut", "drop", "decline", "lawsuit", "risk", "negative", "downgrade"]

# topic -> words, in catalyst priority order
TOPIC_KEYWORDS = {
    "earnings": ["earnings", "results"],
    "guidance": ["guidance", "outlook"],
    "ai": ["ai", "artificial intelligence", "gpu", "model"],
    "lawsuit": ["lawsuit", "litigation", "sued"],
    "analyst": ["analyst", "rating", "price target", "downgrade", "upgrade"],
    "regulatory": ["regulatory", "regulation", "antitrust", "investigation", "sec"],
}
LEGAL_FLAG_WORDS = ["lawsuit", "litigation", "investigation", "antitrust", "sec"]
GUIDANCE_CUT_WORDS = ["cut", "lower", "reduced"]
LONG_HORIZON_WORDS = ["earnings", "guidance", "quarter"]

SENTIMENT_CUT = 0.15
HEURISTIC_CONFIDENCE = 0.35
NOVELTY_SCORES = {"low": 0.2, "medium": 0.55, "high": 0.9}
NOVELTY_DEFAULT = 0.4

# --- fixed values: outcome-labelled extraction set (topic order differs) ----
OUTCOME_TOPICS = {
    "earnings": TOPIC_KEYWORDS["earnings"],
    "guidance": TOPIC_KEYWORDS["guidance"],
    "regulatory": TOPIC_KEYWORDS["regulatory"],
    "lawsuit": TOPIC_KEYWORDS["lawsuit"],
    "analyst": TOPIC_KEYWORDS["analyst"],
    "ai_demand": TOPIC_KEYWORDS["ai"],
}
# ---------------------------------------------------------------------------

# --- fixed values: outcome-labelled set flags and novelty -------------------
OUTCOME_LEGAL_WORDS = ["lawsuit", "litigation", "probe", "investigation"]
OUTCOME_VALUATION_WORDS = ["valuation", "multiple"]
OUTCOME_NOVELTY_WORDS = ["guidance", "beat", "miss", "investigation"]

# --- fixed values: weak-supervision set --------------------------------------
WEAK_POSITIVE_WORDS = ["beat", "strong", "growth", "upbeat", "surge", "win", "record", "expand", "positive"]
WEAK_NEGATIVE_WORDS = ["miss", "weak", "cut", "drop", "decline", "lawsuit", "risk", "negative", "delay"]
WEAK_TOPICS = {
    "earnings": TOPIC_KEYWORDS["earnings"],
    "guidance": TOPIC_KEYWORDS["guidance"],
    "AI_demand": TOPIC_KEYWORDS["ai"],
    "lawsuit": TOPIC_KEYWORDS["lawsuit"],
    "regulatory": TOPIC_KEYWORDS["regulatory"],
    "analyst_change": TOPIC_KEYWORDS["analyst"],
    "product_launch": ["launch", "product"],
}
WEAK_SHORT_HORIZON_WORDS = ["today", "tomorrow", "this week"]
WEAK_LONG_HORIZON_WORDS = ["quarter", "guidance", "earnings"]

# --- fixed values: planner rules ---------------------------------------------
PLANNER_BASE_SOURCES = ["public_finance_news", "company_ir", "sec_filings"]
PLANNER_NOTES = "Generated from real market state and real ingested news availability."
ADJUSTER_RATIONALE = (
    "Adjust the XGBoost baseline only when recent news plausibly changes near-term return expectations."
)
INSTRUCTION_EXTRACT = "Extract stock-relevant trading features as valid JSON."
INSTRUCTION_PLAN = "Generate a stock-news retrieval plan as valid JSON."
INSTRUCTION_ADJUST = "Adjust a stock baseline forecast using fresh news context as valid JSON."
