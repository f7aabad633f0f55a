"""Line-first quality rules (operator 1), DataFrame functions only.

Every line with a word is judged first: a line fails without closing
punctuation or with too many symbols (punctuation rule), as a menu of
separated entries (navigation rule), or by a stock phrase of web pages
(boilerplate rule). Failing lines are removed; a document is rejected when the
base rules fail or when the removed lines hold too much of its text.

Defined results: a null or empty text has no words and is rejected; lines
without a word are neither judged nor removed; repeated rows are judged each
on its own; an empty table gives an empty result; other columns are kept by
``clean_documents`` and not read by ``quality_table``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, NOT_BLANK, let, text_of, words_of

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5

#: Fixed values of the line rules.
LINE_ENDS = [".", "!", "?", "…", '"', "'", "”", "’", "»", ")", "。", "！", "？"]
LINE_SYMBOLS = r"[#*$%&|<>{}\[\]^~=_\\]"
SEPARATORS = r"\s[|›»•·>/]\s"
STOCK_PHRASES = [
    "javascript", "lorem ipsum", "all rights reserved", "terms of use", "terms of service", "privacy policy",
    "cookie policy", "use of cookies", "uses cookies", "sign up", "log in", "click here", "read more", "subscribe to our",
]


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    max_repeat_pct: int = 20
    #: A line may hold one symbol per so many characters.
    chars_per_symbol: int = 20
    #: A line with two separators or more is a menu unless its entries have more words than this.
    menu_words: int = 4
    max_lost_pct: int = 50


def repeat_words(words: Column) -> Column:
    """Words in five-word windows found twice or more in the text.

    The windows are sorted with their places, so equal ones are neighbours;
    n log n in the length of the text. Texts of distinct windows, told apart
    by a hash set, skip the sort.
    """

    def covered(wins: Column) -> Column:
        order = F.sort_array(F.transform(wins, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def places(s: Column) -> Column:
            twin = F.transform(
                s,
                lambda e, j: F.when((F.get(s, j - 1)["x"] == e["x"]) | (F.get(s, j + 1)["x"] == e["x"]), e["i"]),
            )
            return F.sort_array(F.filter(twin, lambda i: i.isNotNull()))

        def total(at: Column) -> Column:
            steps = F.transform(at, lambda i, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - i, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, n: a + n)

        return F.when(F.size(F.array_distinct(wins)) == F.size(wins), F.lit(0).cast("long")).otherwise(let(let(order, places), total))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(WINDOW)]))

    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(let(words, lambda w: let(windows(w), covered)))


def line_fails(line: Column, rules: Rules) -> Column:
    """Whether a line with a word fails one of the three line rules."""
    shown = F.rtrim(line, F.lit(BLANKS))
    unpunctuated = ~F.right(shown, F.lit(1)).isin(LINE_ENDS)
    symbols = F.regexp_count(line, F.lit(LINE_SYMBOLS)) * rules.chars_per_symbol > F.length(line)
    separators = F.regexp_count(line, F.lit(SEPARATORS))
    menu = (separators >= 2) & (F.size(words_of(line)) - separators <= rules.menu_words * (separators + 1))
    lower = F.lower(line)
    stock = F.lit(False)
    for phrase in STOCK_PHRASES:
        stock = stock | F.contains(lower, F.lit(phrase))
    return unpunctuated | symbols | menu | stock


def _judged(docs: DataFrame, id_cols: list[Column], text_col: str, rules: Rules) -> DataFrame:
    text = text_of(text_col)
    base = docs.select(*id_cols, text.alias("_text"), words_of(text).alias("_words"), F.split(text, "\n", -1).alias("_lines"))
    lines = base.withColumn("_spoken", F.filter("_lines", lambda x: x.rlike(NOT_BLANK))).withColumn(
        "_left", F.filter("_lines", lambda x: ~x.rlike(NOT_BLANK) | ~line_fails(x, rules))
    )
    total = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return lines.select(
        *[c for c in base.columns if not c.startswith("_") or c in ("_row",)],
        "_left",
        F.size("_words").cast("long").alias("n_words"),
        total(F.col("_words")).alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_spoken") - F.size(F.array_distinct("_spoken"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_words")).alias("n_repeat_words"),
        (F.size("_lines") - F.size("_left")).cast("long").alias("n_failed_lines"),
        total(F.col("_lines")).alias("_chars"),
        total(F.col("_left")).alias("_chars_left"),
    )


def _verdict(judged: DataFrame, rules: Rules) -> DataFrame:
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_pct * F.col("n_words"))
    lost = F.col("_chars") - F.col("_chars_left")
    return judged.withColumn("base_failed", failed).withColumn("lost_chars", lost).withColumn(
        "kept", ~failed & (100 * lost <= rules.max_lost_pct * F.col("_chars"))
    )


def quality_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """One row per document: id, the counts, base_failed, n_failed_lines, lost_chars, kept."""
    out = _verdict(_judged(docs, [F.col(id_col)], text_col, rules), rules)
    return out.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_failed_lines", "lost_chars", "kept")


def clean_documents(docs: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The kept documents, in the columns of the input, without their failing lines."""
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    kept = _verdict(_judged(docs, [row], text_col, rules), rules).filter("kept")
    return kept.select(*[F.array_join("_left", "\n").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])


def _oracle() -> str:
    ends = ", ".join("'" + e.replace("'", "''") + "'" for e in LINE_ENDS)
    stock = " or ".join(f"contains(lower(x), '{p}')" for p in STOCK_PHRASES)
    r = Rules()
    return rf"""
with d as (
  select doc_id, coalesce(text, '') as t from documents
), w as (
  select doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words, string_split(t, chr(10)) as lines from d
), l as (
  select *, list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as spoken from w
), f as (
  select *, list_filter(spoken, lambda x:
    right(rtrim(x, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)), 1) not in ({ends})
    or len(regexp_extract_all(x, '[#*$%&|<>{{}}\[\]^~=_\\]')) * {r.chars_per_symbol} > length(x)
    or (len(regexp_extract_all(x, '\s[|›»•·>/]\s')) >= 2 and
        len(list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) - len(regexp_extract_all(x, '\s[|›»•·>/]\s'))
          <= {r.menu_words} * (len(regexp_extract_all(x, '\s[|›»•·>/]\s')) + 1))
    or {stock}) as failing from l
), win as (
  select doc_id, unnest(range(1, len(words) - 3)) as i, words from w where len(words) >= 5
), named as (
  select doc_id, i, array_to_string(words[i:i+4], ' ') as x from win
), twice as (
  select doc_id, i, count(*) over (partition by doc_id, x) as n from named
), rep as (
  select doc_id, count(distinct i + k) as n from twice, range(5) r(k) where twice.n >= 2 group by doc_id
), c as (
  select f.doc_id, len(words) as n_words, cast(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as bigint) as word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, len(spoken) - len(list_distinct(spoken)) as n_dup_lines,
    coalesce(rep.n, 0) as n_repeat_words, len(failing) as n_failed_lines,
    cast(coalesce(list_sum(list_transform(failing, lambda x: length(x))), 0) as bigint) as lost_chars,
    cast(coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0) as bigint) as chars
  from f left join rep on f.doc_id = rep.doc_id
), b as (
  select *, n_words < {r.min_words} or 100 * n_repeat_words > {r.max_repeat_pct} * n_words as base_failed from c
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_failed_lines, lost_chars,
  not base_failed and 100 * lost_chars <= {r.max_lost_pct} * chars as kept
from b
"""


ORACLE = _oracle()
