"""STR-1/2: the one-pass matcher against a search word by word."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapeworks.functions import lexicons as lx
from tapeworks.functions.matcher import Matcher, any_of, count_of
from tapeworks.plans.news_events import NEWS_WORDS
from tapeworks.plans.trainsets import OUTCOME_WORDS, WEAK_WORDS

WORD_SETS = [
    ["he", "she", "his", "hers", "her", "s"],
    ["a", "aa", "aaa", "ab", "ba", "abab"],
    ["a.b", "a+b", "(", "[x]", "a-b", "c\\d", "é", "😀x", "two words", "^", "$", "&&"],
    NEWS_WORDS.words, OUTCOME_WORDS.words, WEAK_WORDS.words,
]


def texts(words):
    rng = random.Random(9)
    out = ["", None, " ", "".join(words), " ".join(words), "aababab" * 50]
    letters = "".join(words) + " xé"
    for _ in range(120):
        out.append("".join(rng.choice([rng.choice(words), rng.choice(words)[:-1], rng.choice(letters)]) for _ in range(rng.randrange(25))))
    return out


@pytest.mark.parametrize("words", WORD_SETS, ids=range(len(WORD_SETS)))
def test_finds_what_a_search_word_by_word_finds(spark, words):
    rows = [(i, t) for i, t in enumerate(texts(words))]
    m = Matcher(words)
    got = spark.createDataFrame(rows, "i int, t string").select("i", m.found(F.col("t")).alias("found")).collect()
    for r in got:
        t = rows[r.i][1] or ""
        assert sorted(r.found) == sorted(w for w in set(words) if w in t)


def test_tests_on_what_was_found(spark):
    row = spark.createDataFrame([("strong growth, weak cut",)], "t string").select(NEWS_WORDS.found(F.col("t")).alias("f"))
    out = row.select(any_of(F.col("f"), ["weak"]), any_of(F.col("f"), ["miss"]), any_of(F.col("f"), []), count_of(F.col("f"), [*lx.POSITIVE_WORDS, "strong"]), count_of(F.col("f"), [])).first()
    assert tuple(out) == (True, False, False, 2, 0)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab.é|", min_size=1, max_size=4), min_size=1, max_size=6), st.text("ab.é|", max_size=20))
def test_overlapping_and_nested_words_are_all_found(words, text):
    m = Matcher(words)
    assert [m.words[i] for i in m.places(text)] == [w for w in m.words if w in text]


def test_refuses_empty_words():
    with pytest.raises(ValueError):
        Matcher([])
    with pytest.raises(ValueError):
        Matcher(["a", ""])


def test_long_text_is_read_once(spark):
    t = "x" * 3_000_000 + " downgrade"
    row = spark.createDataFrame([(t,)], "t string").select(NEWS_WORDS.found(F.col("t")).alias("f")).first()
    assert sorted(row.f) == ["downgrade"]
