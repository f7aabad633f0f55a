"""Mixing sources to target weights by Poisson replication (operator 5).

Each source gets the mean repetition rate that brings it to its target share;
a document's number of copies is that Poisson distribution, inverted at a
number between 0 and 1 that a hash of seed and document id gives. Copies are
exploded and shuffled globally by the hash of seed, id and copy.

Defined results: a null text or id is mixed like any other (null ids share one
draw, as rows with equal ids do); a source that ``weights`` does not name, null
included, belongs to the one group of others; a group without rows or with
weight 0 gives no rows, and the other weights are scaled to 1; an empty table
gives an empty result; all columns of the input are kept, and a column with
the name of an added one is refused.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import executors_tasks

#: Equal shares of the twenty named sources; all others together count as one more.
DEFAULT_WEIGHTS = {f"src{i}": 1.0 for i in range(20)}
MAX_SOURCES = 100_000
HEX_DIGITS = 13


def poisson_steps(rate: float) -> list[float]:
    """P(copies <= k) for k = 0, 1, ... up to where nothing is left."""
    if rate <= 0:
        return [1.0]
    out, total, k = [], 0.0, 0
    while True:
        p = math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
        total += p
        if k > rate and p < 1e-18:
            return out
        out.append(total)
        k += 1


def _name(df: DataFrame, source_col: str, weights: Mapping[str, float]):
    """The named source, or an empty string for all others."""
    names = df.sparkSession.createDataFrame([(k,) for k in weights], "_m_name string")
    return df.join(F.broadcast(names), F.col(source_col) == F.col("_m_name"), "left").withColumn("_m_name", F.coalesce("_m_name", F.lit("")))


def rates(docs: DataFrame, source_col: str, weights: Mapping[str, float], other_weight: float, epochs: float) -> dict[str, float]:
    """The mean number of copies by group; one row per named source reaches the driver."""
    if len(weights) > MAX_SOURCES:
        raise ValueError(f"weights name {len(weights)} sources; {MAX_SOURCES} is the most that is broadcast")
    counts = {r[0]: r[1] for r in _name(docs.select(source_col), source_col, weights).groupBy("_m_name").count().collect()}
    of = lambda k: weights[k] if k else other_weight
    whole, rows = sum(of(k) for k in counts), sum(counts.values())
    return {k: epochs * rows * of(k) / whole / n if whole else 0.0 for k, n in counts.items()}


def mix(docs: DataFrame, weights: Mapping[str, float] = DEFAULT_WEIGHTS, other_weight: float = 1.0, epochs: float = 1.0, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", bookkeeping: bool = True) -> DataFrame:
    """All columns, once per copy, in shuffled order; with ``bookkeeping`` also n_copies, copy and shuffle_key.

    What is broadcast has one row per named source, MAX_SOURCES at most.
    """
    if clash := {c.lower() for c in docs.columns} & {"n_copies", "copy", "shuffle_key", "_m_name", "_m_steps"}:
        raise ValueError(f"the input already has columns {sorted(clash)}")
    own = rates(docs, source_col, weights, other_weight, epochs)
    steps = docs.sparkSession.createDataFrame([(k, poisson_steps(r)) for k, r in own.items()], "_m_name string, _m_steps array<double>")
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    draw = F.conv(F.substring(F.md5(key), 1, HEX_DIGITS), 16, 10).cast("bigint") / F.lit(float(16**HEX_DIGITS))
    counted = _name(docs, source_col, weights).join(F.broadcast(steps), "_m_name").withColumn("_m_draw", draw)
    counted = counted.withColumn("n_copies", F.size(F.filter("_m_steps", lambda p: p <= F.col("_m_draw"))).cast("long")).drop("_m_steps", "_m_draw", "_m_name")
    copies = counted.filter("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n_copies")))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat(key, F.lit(":"), F.col("copy").cast("string"))))
    shuffled = keyed.repartition(executors_tasks(docs.sparkSession), "shuffle_key").sortWithinPartitions("shuffle_key")
    return shuffled if bookkeeping else shuffled.select(*docs.columns)


ORACLE = f"""
with recursive w(name, weight) as (
  values {", ".join(f"('{k}', {v:.1f}::double)" for k, v in DEFAULT_WEIGHTS.items())}, ('', 1.0::double)
), d as (
  select documents.*, coalesce(w.name, '') as name from documents left join w on documents.source = w.name and w.name <> ''
), n as (
  select name, count(*) as n from d group by name
), rate as (
  select n.name, (select count(*) from d) * weight / (select sum(weight) from w where name in (select name from n)) / n as rate from n join w on n.name = w.name
), p as (
  select name, k, exp(-rate + k * ln(rate) - case when k < 2 then 0 else lgamma(k + 1) end) as p from rate, range(200) r(k)
), steps as (
  select name, k, sum(p) over (partition by name order by k) as step from p
), u as (
  select *, (cast('0x' || substr(md5('17:' || coalesce(cast(doc_id as varchar), '')), 1, 13) as bigint)) / 4503599627370496.0::double as draw from d
), c as (
  select u.doc_id, u.name, count(*) filter (step <= draw) as n_copies from u join steps on u.name = steps.name group by u.doc_id, u.name
), x as (
  select doc_id, n_copies, unnest(range(1, n_copies + 1)) as copy from c
)
select documents.*, n_copies, copy, md5('17:' || x.doc_id || ':' || copy) as shuffle_key
from x join documents on x.doc_id = documents.doc_id
"""
