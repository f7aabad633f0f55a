"""Repeated runs of lines (operator 4), DataFrame functions only.

Documents are sequences of line ids (lines without a word are left out).
Prefix doubling ranks their suffixes: round k knows the rank of the 2**k lines
from each place on, and the rank of twice as many follows from two of them; a
place whose prefix occurs once leaves the race. The suffixes that share their
first n lines are an interval of the suffix order with a longest common prefix
of n lines or more; the intervals where that prefix has ``min_chars``
characters are the repeated runs (longer runs are covered by the intervals of
the places that follow). In each interval the first place, by document id and
line, stays; the lines of the others are deleted, and side by side they make
the maximal runs. Since each line has a character, the depth needed is
``min_chars`` lines at most, whatever the corpus holds.

Defined results: a null or empty text has no lines and stays as it is; equal
rows are copies like others, told apart by a row number (null ids come last);
lines are judged on the input, so a later copy that overlaps the first takes
the shared lines with it; an empty table gives an empty result; other columns
are kept as they are, and the names used within (``_l_...``) are no clash as
long as the input does not use that prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rank import global_row_number
from .common import NOT_BLANK, stored

MIN_CHARS = 50


def _spoken(lines: Column) -> Column:
    return F.filter(lines, lambda x: x.rlike(NOT_BLANK))


def _places(base: DataFrame, min_chars: int) -> DataFrame:
    """(row, id, i, line, need): every spoken line, and how many from it on make ``min_chars``."""
    arrays = base.select("_l_row", "_l_id", _spoken(F.split("_l_text", "\n", -1)).alias("lines"))
    arrays = arrays.withColumn("chars", F.transform("lines", lambda x: F.length(x)))

    def need(i: Column) -> Column:
        zero = F.struct(F.lit(0).alias("c"), F.lit(0).alias("n"))
        step = lambda a, x: F.when(a["c"] >= min_chars, a).otherwise(F.struct((a["c"] + x).alias("c"), (a["n"] + 1).alias("n")))
        got = F.aggregate(F.slice("chars", i + 1, min_chars), zero, step, lambda a: F.when(a["c"] >= min_chars, a["n"]))
        return F.when(F.get("chars", i) >= min_chars, F.lit(1)).otherwise(got)

    rows = F.transform("lines", lambda x, i: F.struct(i.alias("i"), F.unhex(F.md5(x)).alias("line"), need(i).alias("need")))
    return arrays.select(F.col("_l_row").alias("row"), F.col("_l_id").alias("id"), F.inline(rows))


def _ranked(places: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Places whose key occurs twice or more, with the key's rank.

    Counts are combined within tasks; the rank comes from a range-partitioned
    sort of the distinct keys, so no common key gathers its places.
    """
    often = places.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1").select(*keys)
    ranks = global_row_number(stored(often, f"{name}-keys"), [], [(k, True) for k in keys], out="rank")
    ranks = stored(ranks.select(*keys, "rank"), f"{name}-ranks")
    return stored(places.join(ranks, keys).drop(*keys), name)


def _shift(places: DataFrame, by: Column, name: str) -> DataFrame:
    """(row, i, name): the rank at i + by, by place i."""
    return places.select("row", (F.col("i") - by).alias("i"), F.col("rank").alias(name))


def later_copies(base: DataFrame, min_chars: int) -> DataFrame:
    """(row, i, need): places whose next ``need`` lines are a later copy of a repeated run."""
    lines = stored(_places(base, min_chars), "lines")
    now = _ranked(lines, ["line"], "suffixes-1")
    deepest = now.agg(F.max("need")).first()[0] or 1  # min_chars at most
    found, size = [], 1
    while True:
        own = now.filter((F.col("need") >= size) & (F.col("need") < 2 * size))
        ends = own.select("row", "i", "id", "need", "rank", (F.col("i") + F.col("need") - size).alias("last"))
        tails = now.select("row", F.col("i").alias("last"), F.col("rank").alias("tail"))
        found.append(ends.join(tails, ["row", "last"]).select("row", "i", "id", "need", "rank", "tail"))
        if 2 * size > deepest:
            break
        pairs = now.join(_shift(now, F.lit(size), "next"), ["row", "i"])
        now = _ranked(pairs.withColumnRenamed("rank", "head"), ["head", "next"], f"suffixes-{2 * size}")
        size *= 2
    runs = found[0]
    for more in found[1:]:
        runs = runs.unionByName(more)
    runs = stored(runs, "runs")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "row", "i")
    interval = ["need", "rank", "tail"]
    firsts = stored(runs.groupBy(*interval).agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("first")).filter("copies > 1").select(*interval, F.col("first.row").alias("first_row"), F.col("first.i").alias("first_i")), "intervals")
    return runs.join(firsts, interval).filter((F.col("row") != F.col("first_row")) | (F.col("i") != F.col("first_i"))).select("row", "i", "need")


def _judged(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """The rows of ``docs`` as ``_l_doc`` with their lines and which of them go.

    The input is written once with row numbers, so that all steps see the same
    ones even when a lost executor's part is read again.
    """
    base = stored(
        docs.select(F.struct(*[F.col(c) for c in docs.columns if c != text_col]).alias("_l_doc") if len(docs.columns) > 1 else F.lit(None).alias("_l_doc"), F.col(text_col).alias("_l_text"), F.col(id_col).alias("_l_id")).withColumn("_l_row", F.monotonically_increasing_id()),
        "line-documents",
    )
    gone = later_copies(base, min_chars).select("row", F.explode(F.sequence("i", F.col("i") + F.col("need") - 1)).alias("i"))
    gone = gone.groupBy(F.col("row").alias("_l_row")).agg(F.collect_set("i").alias("_l_gone"))
    lines = F.split("_l_text", "\n", -1)
    at = F.filter(F.transform(lines, lambda x, j: F.when(x.rlike(NOT_BLANK), j)), lambda j: j.isNotNull())
    out = base.join(gone, "_l_row", "left").withColumn("_l_lines", lines).withColumn("_l_at", at).withColumn("_l_gone", F.array_sort(F.coalesce("_l_gone", F.array().cast("array<int>"))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_l_lines") - 1), F.transform("_l_gone", lambda d: F.get("_l_at", d)))
    text = F.when(F.size("_l_gone") == 0, F.col("_l_text")).otherwise(F.array_join(F.transform(kept, lambda j: F.get("_l_lines", j)), "\n"))
    return out.withColumn("_l_left", text)


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per document: id, n_lines (with a word), n_deleted, n_runs (maximal deleted runs), text."""
    runs = F.size(F.filter(F.transform("_l_gone", lambda d, j: d - F.coalesce(F.get("_l_gone", j - 1), F.lit(-2))), lambda step: step > 1))
    lines = F.when(F.col("_l_text").isNull(), F.lit(0)).otherwise(F.size("_l_at"))
    return _judged(docs, id_col, text_col, min_chars).select(F.col("_l_id").alias(id_col), lines.cast("long").alias("n_lines"), F.size("_l_gone").cast("long").alias("n_deleted"), runs.cast("long").alias("n_runs"), F.col("_l_left").alias("text"))


def without_later_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """The input's columns with the copies deleted; documents that lose all their lines go."""
    out = _judged(docs, id_col, text_col, min_chars).filter((F.size("_l_gone") == 0) | (F.size("_l_gone") < F.size("_l_at")))
    return out.select(*[F.col("_l_left").alias(c) if c == text_col else F.col("_l_doc")[c].alias(c) for c in docs.columns])


ORACLE = rf"""
with recursive d as (
  select doc_id, text, string_split(text, chr(10)) as all_lines from documents
), l as (
  select doc_id, list_filter(coalesce(all_lines, []), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d
), p as (
  select doc_id, lines, unnest(range(len(lines))) as i from l
), need as (
  select doc_id, i, lines, (select min(n) from range(1, {MIN_CHARS} + 1) r(n)
    where i + n <= len(lines) and list_sum(list_transform(lines[i + 1 : i + n], lambda x: length(x))) >= {MIN_CHARS}) as n from p
), runs as (
  select doc_id, i, n, row_number() over (partition by n, array_to_string(lines[i + 1 : i + n], chr(10)) order by doc_id, i) as copy from need where n is not null
), gone as (
  select distinct doc_id, i + k as i from runs, range({MIN_CHARS}) r(k) where copy > 1 and k < n
), edges as (
  select doc_id, i, i - coalesce(lag(i) over (partition by doc_id order by i), -2) > 1 as starts from gone
), per as (
  select doc_id, count(*) as n_deleted, count(*) filter (starts) as n_runs, list(i) as gone from edges group by doc_id
), numbered as (
  select doc_id, unnest(all_lines) as line, unnest(range(len(all_lines))) as j from d
), spoken as (
  select *, cast(sum(case when regexp_matches(line, '[^\x20\x09-\x0D]') then 1 else 0 end) over (partition by doc_id order by j) as bigint) - 1 as i from numbered
), left_over as (
  select s.doc_id, string_agg(line, chr(10) order by j) as text from spoken s left join gone g on s.doc_id = g.doc_id and s.i = g.i and regexp_matches(line, '[^\x20\x09-\x0D]')
  where g.i is null group by s.doc_id
)
select d.doc_id, len(l.lines) as n_lines, coalesce(per.n_deleted, 0) as n_deleted, coalesce(per.n_runs, 0) as n_runs,
  case when per.n_deleted is null then d.text else coalesce(left_over.text, '') end as text
from d join l on d.doc_id = l.doc_id left join per on d.doc_id = per.doc_id left join left_over on d.doc_id = left_over.doc_id
"""
